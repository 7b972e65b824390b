"""Catalogues of public e-books: texts without and with stream of consciousness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.readers import catalog, repeated_books

# Fixed values: (number, author, title) of the books, and the positive ones' techniques; 2166 and 1400 are listed twice, and 2775 in both lists.
NEGATIVES = (
    (244, "Arthur Conan Doyle", "A Study in Scarlet"),
    (1661, "Arthur Conan Doyle", "The Adventures of Sherlock Holmes"),
    (2097, "Arthur Conan Doyle", "The Memoirs of Sherlock Holmes"),
    (2852, "Arthur Conan Doyle", "The Hound of the Baskervilles"),
    (108, "Arthur Conan Doyle", "The Return of Sherlock Holmes"),
    (583, "Wilkie Collins", "The Woman in White"),
    (155, "Wilkie Collins", "The Moonstone"),
    (36, "H.G. Wells", "The Time Machine"),
    (718, "H.G. Wells", "The War of the Worlds"),
    (159, "H.G. Wells", "The Island of Doctor Moreau"),
    (776, "H.G. Wells", "When the Sleeper Wakes"),
    (1743, "H.G. Wells", "The Invisible Man"),
    (164, "Jules Verne", "Around the World in Eighty Days"),
    (103, "Jules Verne", "Twenty Thousand Leagues Under the Sea"),
    (83, "Jules Verne", "The Mysterious Island"),
    (3526, "Jules Verne", "Michael Strogoff"),
    (4791, "Jules Verne", "From the Earth to the Moon"),
    (2166, "H. Rider Haggard", "She"),
    (2166, "H. Rider Haggard", "King Solomon's Mines"),
    (95, "Anthony Hope", "The Prisoner of Zenda"),
    (1951, "Anthony Hope", "Rupert of Hentzau"),
    (120, "R.L. Stevenson", "Treasure Island"),
    (858, "R.L. Stevenson", "Kidnapped"),
    (98, "Charles Dickens", "A Tale of Two Cities"),
    (730, "Charles Dickens", "Oliver Twist"),
    (821, "Charles Dickens", "Hard Times"),
    (588, "Charles Dickens", "Dombey and Son"),
    (967, "Charles Dickens", "Martin Chuzzlewit"),
    (1400, "Charles Dickens", "Great Expectations"),
    (766, "Charles Dickens", "David Copperfield"),
    (3256, "Anthony Trollope", "The Warden"),
    (4181, "Anthony Trollope", "Barchester Towers"),
    (9462, "Anthony Trollope", "The Way We Live Now"),
    (5140, "Anthony Trollope", "Doctor Thorne"),
    (74, "Mark Twain", "The Adventures of Tom Sawyer"),
    (76, "Mark Twain", "Adventures of Huckleberry Finn"),
    (102, "Mark Twain", "The Prince and the Pauper"),
    (245, "Mark Twain", "Life on the Mississippi"),
    (308, "Jerome K. Jerome", "Three Men in a Boat"),
    (1400, "Jerome K. Jerome", "Three Men on the Bummel"),
    (82, "Walter Scott", "Ivanhoe"),
    (84, "Walter Scott", "Waverley"),
    (1184, "Alexandre Dumas", "The Three Musketeers"),
    (1257, "Alexandre Dumas", "Twenty Years After"),
    (2759, "Alexandre Dumas", "The Count of Monte Cristo"),
    (2775, "Rudyard Kipling", "Plain Tales from the Hills"),
    (2226, "Rudyard Kipling", "The Jungle Book"),
    (236, "Rudyard Kipling", "Kim"),
    (910, "Jack London", "The Call of the Wild"),
    (1164, "Jack London", "White Fang"),
    (1696, "Jack London", "The Sea-Wolf"),
    (2776, "O. Henry", "Cabbages and Kings"),
    (4735, "Anthony Trollope", "He Knew He Was Right"),
    (7234, "W.W. Jacobs", "The Monkey's Paw and Other Stories"),
    (1726, "Jonathan Swift", "Gulliver's Travels"),
)
POSITIVES = (
    (4300, "James Joyce", "Ulysses", "direct_interior_monologue + hybrid"),
    (4217, "James Joyce", "A Portrait of the Artist as a Young Man", "indirect_interior_monologue"),
    (2814, "James Joyce", "Dubliners", "indirect_interior_monologue"),
    (5765, "Virginia Woolf", "Mrs Dalloway", "indirect_interior_monologue + reverie_fantasy"),
    (690, "Virginia Woolf", "To the Lighthouse", "indirect_interior_monologue"),
    (43524, "Virginia Woolf", "The Waves", "direct_interior_monologue"),
    (5550, "Virginia Woolf", "Jacob's Room", "indirect_interior_monologue"),
    (4517, "Dorothy Richardson", "Pointed Roofs", "indirect_interior_monologue"),
    (4518, "Dorothy Richardson", "Backwater", "indirect_interior_monologue"),
    (4519, "Dorothy Richardson", "Honeycomb", "indirect_interior_monologue"),
    (34219, "May Sinclair", "Mary Olivier: A Life", "indirect_interior_monologue"),
    (42984, "Edouard Dujardin", "We'll to the Woods No More", "direct_interior_monologue"),
    (2775, "Ford Madox Ford", "The Good Soldier", "reverie_fantasy + indirect_interior_monologue"),
    (432, "Henry James", "The Ambassadors", "indirect_interior_monologue"),
    (209, "Henry James", "The Wings of the Dove", "indirect_interior_monologue"),
    (1149, "Henry James", "The Turn of the Screw", "indirect_interior_monologue"),
    (32220, "Arthur Schnitzler", "Lieutenant Gustl", "direct_interior_monologue"),
    (160, "Kate Chopin", "The Awakening", "indirect_interior_monologue + reverie_fantasy"),
    (1399, "Leo Tolstoy", "Anna Karenina", "indirect_interior_monologue + reverie_fantasy"),
    (600, "Fyodor Dostoevsky", "Notes from Underground", "soliloquy"),
    (2413, "Gustave Flaubert", "Madame Bovary", "indirect_interior_monologue"),
    (15408, "Gertrude Stein", "Three Lives", "indirect_interior_monologue"),
)


def negatives(spark: SparkSession) -> DataFrame:
    return catalog(spark, list(NEGATIVES))


def positives(spark: SparkSession) -> DataFrame:
    """The positive list, with the techniques that each work is known for (types, joined by plus signs)."""
    named = spark.createDataFrame([(p[0], p[3]) for p in POSITIVES], "t_id int, technique string").dropDuplicates(["t_id"])
    return catalog(spark, [p[:3] for p in POSITIVES]).join(named, F.col("id") == F.col("t_id")).drop("t_id")


def repeated(spark: SparkSession) -> DataFrame:
    """Numbers that a list has twice or both lists have, which a download would mix up."""
    schema = "id int, author string, title string"
    return repeated_books(spark.createDataFrame(NEGATIVES, schema), spark.createDataFrame([p[:3] for p in POSITIVES], schema))
