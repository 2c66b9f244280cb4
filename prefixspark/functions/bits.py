"""Bit codecs as Column expressions: tagged pointers, inline payloads, event words, nibbles, population-count ranks.

Words are BIGINT bit patterns: a pointer whose top bit is set is negative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pointer layout, as first bit and width.
TYPE, OFFSET, ARENA, TOMBSTONE, POLY = (0, 3), (3, 40), (43, 4), (47, 1), (48, 16)
# An inlined payload's low and high part around the tombstone, as first bit and width.
INLINE_LOW, INLINE_HIGH, INLINE_BITS = (3, 44), (48, 12), 56
# Node types by number; 6 and 7 are not valid and read back as an inlined leaf.
NODE_TYPES = ("LeafInlined", "LeafOffset", "Node4", "Node16", "Node64", "Node256")
# Event kinds by number; other numbers read back as the last. Kind, first and second field are 8, 28 and 28 bits.
EVENT_KINDS = ("TreeInsert", "CasContention", "TreeHit", "VectorInsert", "VectorSearch", "Recluster", "KvInsert", "KvMatch", "WalFlush", "ClockEvict")
# Node families by most children.
FAMILIES = ((4, "Node4"), (16, "Node16"), (64, "Node64"), (256, "Node256"))


def _long(c: Column | str | int) -> Column:
    return F.lit(c).cast("long") if isinstance(c, int) else (F.col(c) if isinstance(c, str) else c).cast("long")


def field(word: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(word, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1).cast("long"))


def _put(value, at: tuple[int, int]) -> Column:
    return F.shiftleft(_long(value).bitwiseAND(F.lit((1 << at[1]) - 1).cast("long")), at[0])


def _join(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def pack_pointer(node_type, offset, arena, tombstone, poly) -> Column:
    """One word from its fields; each is cut to its width. ``tombstone`` is a boolean."""
    return _join([_put(node_type, TYPE), _put(offset, OFFSET), _put(arena, ARENA), _put(tombstone, TOMBSTONE), _put(poly, POLY)])


def unpack_pointer(word: Column) -> dict[str, Column]:
    number = field(word, TYPE)
    return {
        "node_type": F.when(number < len(NODE_TYPES), number).otherwise(F.lit(0)).cast("int"),
        "offset": field(word, OFFSET),
        "arena": field(word, ARENA).cast("int"),
        "tombstone": field(word, TOMBSTONE) == 1,
        "poly": field(word, POLY).cast("int"),
    }


def mark_tombstone(word: Column) -> Column:
    return word.bitwiseOR(F.lit(1 << TOMBSTONE[0]).cast("long"))


def pack_inline(payload, tombstone) -> Column:
    """A 56-bit payload around the tombstone bit; type zero, top bits clear."""
    p, low = _long(payload), INLINE_LOW[1]
    return _join([_put(p, INLINE_LOW), _put(F.shiftrightunsigned(p, low), INLINE_HIGH), _put(tombstone, TOMBSTONE)])


def unpack_inline(word: Column) -> dict[str, Column]:
    return {"payload": field(word, INLINE_LOW).bitwiseOR(F.shiftleft(field(word, INLINE_HIGH), INLINE_LOW[1])), "tombstone": field(word, TOMBSTONE) == 1}


def leaf_kind(value: Column) -> Column:
    """Values below 2^56 lie in the word, others in a slot of their own."""
    return F.when(value < F.lit(1 << INLINE_BITS), F.lit("LeafInlined")).otherwise(F.lit("LeafOffset"))


def encode_event(kind, a, b) -> Column:
    return _join([_put(kind, (56, 8)), _put(a, (28, 28)), _put(b, (0, 28))])


def decode_event(word: Column) -> dict[str, Column]:
    kind = F.coalesce(F.get(F.array(*map(F.lit, EVENT_KINDS)), field(word, (56, 8)).cast("int")), F.lit(EVENT_KINDS[-1]))
    return {"kind": kind, "a": field(word, (28, 28)).cast("int"), "b": field(word, (0, 28)).cast("int")}


def event_text(kind: Column, a: Column, b: Column) -> Column:
    return F.format_string("%s a=%d b=%d", kind, a, b)


def nibbles(key: Column) -> Column:
    """The key's half bytes, high first: one hexadecimal digit each."""
    return F.transform(F.filter(F.split(F.hex(key), ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))


def child_rank(mask: Column, nibble: Column, tombstone: Column | bool = False) -> Column:
    """A child's place among those present, null if it is absent or the word is a tombstone."""
    present = F.getbit(_long(mask), nibble.cast("int")) == 1
    below = F.bit_count(_long(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), nibble.cast("int")) - 1))
    dead = F.lit(tombstone) if isinstance(tombstone, bool) else tombstone
    return F.when(present & ~dead, below.cast("int"))


def node_family(n_children: Column) -> Column:
    out = F.lit(FAMILIES[-1][1])
    for most, name in reversed(FAMILIES[:-1]):
        out = F.when(n_children <= most, F.lit(name)).otherwise(out)
    return out
