"""Schemas of the engine's tables, as DDL. Unsigned 64-bit values that may reach 2^63 are DECIMAL(20,0)."""

KV_OPS = "seq BIGINT, op STRING, key BINARY, value DECIMAL(20,0)"
KV_STATE = "key BINARY, value DECIMAL(20,0)"
CENTROIDS = "centroid INT, vec ARRAY<DOUBLE>"
CODEBOOK = "sub INT, code INT, vec ARRAY<DOUBLE>"
POSTINGS = "centroid INT, id BIGINT, code ARRAY<SMALLINT>"
JOURNAL = "id BIGINT, vec ARRAY<FLOAT>"
HITS = "query_id BIGINT, rank INT, id BIGINT, distance DOUBLE"
CACHE_OPS = "seq BIGINT, op STRING, tokens ARRAY<BIGINT>, kv_offset BIGINT, steps INT"
PREFIX_MATCH = "query_id BIGINT, token_len INT, kv_offset BIGINT"
FRAMES = "tx_id BIGINT, pos INT, is_parent BOOLEAN, lsn BIGINT, opcode TINYINT, offset BIGINT, payload BINARY"
EVENT_WORDS = "seq BIGINT, word BIGINT"
