"""Chats as training tokens: rendered by a template, encoded and cut, labelled, and padded in batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators.ordering import running_total

#: The label of tokens that a loss leaves out.
IGNORED = -100
#: make_encoder() runs once in each task and gives a function from texts to their ids.
Encoder = Callable[[list[str]], list[list[int]]]


@dataclass(frozen=True)
class ChatTemplate:
    """What stands before and after each message; {role} is its role. The default is the common form with start and end marks."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    marks: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<think>", "</think>")
    think_end: str = "</think>"

    def text(self, messages: Column, answer_next: bool = False) -> Column:
        """Messages (role, content) as one text; null roles and contents are empty, null messages give the empty text. answer_next opens the assistant's turn at the end."""
        some = lambda c: F.coalesce(c, F.lit(""))
        turn = F.transform(messages, lambda m: F.concat(F.replace(F.lit(self.before), F.lit("{role}"), some(m["role"])), some(m["content"]), F.lit(self.after)))
        return F.concat(F.coalesce(F.array_join(turn, "", ""), F.lit("")), F.lit(self.before.replace("{role}", "assistant") if answer_next else ""))


def file_encoder(path: str, marks: tuple[str, ...] = ()) -> Callable[[], Encoder]:
    """A maker of encoders by a tokenizers file, to which marks are added that it lacks, each a token of its own."""

    def make() -> Encoder:
        # a task is one core's work; the library's own threads would each keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens(list(marks))
        t.no_truncation()
        t.no_padding()
        return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    return make


def encoded(chats: DataFrame, make_encoder: Callable[[], Encoder], max_length: int, text: str = "chat_text", batch_chars: int = 200_000) -> DataFrame:
    """chats with a column input_ids: the ids of `text`, the first max_length of them. A null text has none.

    Texts go to the encoder in batches of batch_chars characters at most (a longer text is one by itself), and their ids are handed on
    by batch: what the library keeps of a token is some hundred bytes until its batch is done.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chats.schema) + ", input_ids array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= batch_chars):
                    size += len(texts[end])
                    end += 1
                ids = [x[:max_length] for x in encode(texts[start:end])]
                yield b.slice(start, end - start).append_column("input_ids", pa.array(ids, pa.list_(pa.int32())))
                start = end

    return chats.mapInArrow(run, schema)


def think_labels(ids: Column, end_ids: list[int]) -> Column:
    """ids with IGNORED in place of all up to the last one that is among end_ids (the ids of a closing think tag); all stay where there is none."""
    last = F.lit(0)
    for i in sorted(set(end_ids)):
        back = F.array_position(F.reverse(ids), i)
        last = F.greatest(last, F.when(back > 0, F.size(ids) - back + 1).otherwise(0))
    last = last.cast("int")
    return F.concat(F.array_repeat(F.lit(IGNORED), last), F.slice(ids, last + 1, F.greatest(F.size(ids), F.lit(1))))


def training_tokens(chats: DataFrame, make_encoder: Callable[[], Encoder], max_length: int, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Chats (messages, ...) with input_ids and labels in place of messages: rendered, encoded, cut, thoughts left out of the labels."""
    end_ids = make_encoder()([template.think_end])[0]
    rows = encoded(chats.withColumn("chat_text", template.text(F.col("messages"))).drop("messages"), make_encoder, max_length)
    return rows.drop("chat_text").withColumn("labels", think_labels(F.col("input_ids"), end_ids))


def padded_batches(rows: DataFrame, key: str, batch: int, pad_id: int) -> DataFrame:
    """rows (key, input_ids, labels, ...) in batches of so many rows in the order of the unique `key`: each padded to its batch's longest.

    New columns batch (from 0) and attention_mask; padding has mask 0 and label IGNORED. Only keys and lengths are numbered and
    windowed; the ids move once, to where their batch's length is.
    """
    lengths = rows.select(F.col(key).alias("p_key"), F.size("input_ids").alias("p_n"), F.lit(1).alias("p_one"))
    placed = running_total(lengths, "p_key", "p_one", "p_place").withColumn("batch", F.floor(F.col("p_place") / batch))
    placed = placed.withColumn("p_longest", F.max("p_n").over(W.partitionBy("batch"))).select("p_key", "batch", "p_longest")
    more = F.col("p_longest") - F.size("input_ids")
    out = rows.join(placed, F.col(key) == F.col("p_key"))
    return (
        out.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), more)))
        .withColumn("labels", F.concat("labels", F.array_repeat(F.lit(IGNORED), more))).withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), more)))
        .drop("p_key", "p_longest")
    )
