"""Fixed values of the memory model, in one place."""

from __future__ import annotations

import datetime as dt

#: The clock of the registered queries; operators take it as a parameter.
CLOCK = dt.datetime(2024, 3, 1)

# Retrieval.
VECTOR_K, MIN_SIMILARITY, MAX_TOKENS = 12, 0.55, 1200
RRF_K, MMR_LAMBDA, MAX_FACTS, CLAIM_LIMIT = 60, 0.7, 12, 24
WALK_HOPS, EDGES_PER_NODE, EDGES_PER_HOP = 2, 8, 20
TRIGRAM_FLOOR, NAME_FLOOR, NAME_TOP, LINK_LIMIT = 0.6, 0.8, 3, 20

# The graph of mentions.
MAGNITUDE_CAP, EMA_LOW, EMA_HIGH, PROVENANCE_CAP = 8.0, 0.05, 0.4, 32
BEAM_WEIGHTS, BEAM_DECAY, BEAM_FLOOR, TURN_WINDOW = (0.4, 0.4, 0.2), 0.05, 0.05, 32
MAX_DESTINATIONS = 32
COMPACTION_COSINE, ORPHAN_DAYS, CONCEPT_SNAP = 0.92, 7, 0.85
GHOST_THRESHOLD, HALF_LIFE_DAYS = 0.70, 30

# Text.
TURN_MIN_CHARS, CHUNK_CHARS, MAX_NOUNS = 40, 4000, 5

# Jobs.
BATCH_SIZE, BATCH_IDLE_S, BATCH_MAX_S, MAX_ATTEMPTS = 8, 600, 1800, 5
BACKOFF_S = (5, 30, 120, 600, 600)

FUNCTIONAL_VERBS = ("signup", "purchase")
