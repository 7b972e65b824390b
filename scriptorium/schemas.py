"""Row shapes of the annotation data, and its fixed vocabularies."""

from __future__ import annotations

CHUNK = "source_file string, chunk_id string, chunk_label string, chunk_text string, chunk_index int, context_before string, context_after string"
INSTANCE = "passage string, soc_type string, secondary_devices array<string>, affective_register string, narrator_position string, character_pov string, is_soc boolean, explanation string, evidence array<string>, confidence string, notes string"
RESULT = "model_label string, source_file string, chunk_id string, chunk_label string, chunk_index int, passage string, soc_type string, secondary_devices string, affective_register string, narrator_position string, character_pov string, explanation string, evidence string, confidence string, notes string"
CONSENSUS_COLUMNS = ("source_file", "chunk_id", "chunk_label", "chunk_index", "passage", "soc_type", "secondary_devices", "affective_register", "narrator_position", "character_pov", "explanation", "evidence", "confidence", "notes", "n_models", "models_agreed", "agreement")
TRAINING = "source_file string, chunk_id string, passage string, is_soc boolean, hard_negative boolean, think_content string, assistant_json string"
JUDGE = "grounding double, skepticism double, specificity double, type_coherence double, rationale string"

# The type, position and confidence vocabularies. Rows with other values are kept.
SOC_TYPES = ("direct_interior_monologue", "indirect_interior_monologue", "omniscient_description", "soliloquy", "free_association", "space_montage", "orthographic_marker", "imagery", "simulation_state_of_mind", "reverie_fantasy", "hybrid", "other_soc")
DEPRECATED_TYPES = ("soliloquy", "space_montage")
NARRATOR_POSITIONS = ("absent", "minimal", "present", "dominant")
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
TYPE_LABELS = {"direct_interior_monologue": "Direct Interior Monologue", "indirect_interior_monologue": "Indirect Interior Monologue", "omniscient_description": "Omniscient Description", "soliloquy": "Soliloquy", "free_association": "Free Association", "space_montage": "Space-Montage", "orthographic_marker": "Orthographic Marker", "imagery": "Imagery", "simulation_state_of_mind": "Simulation of State of Mind", "reverie_fantasy": "Reverie / Fantasy", "hybrid": "Hybrid"}
# Words that show a trace to be specific, and phrases that show it to be sceptical.
SPECIFIC_WORDS = (*SOC_TYPES, "humphrey", "steinberg", "free indirect", "interior monologue")
SCEPTICAL_PHRASES = ("non-soc", "not soc", "could appear", "conventional narration", "narrated psychology", "narrator retains", "psycho-narration", "would need", "falls short", "does not qualify", "narrator's voice", "narrator describes", "no interior", "no unmediated")
