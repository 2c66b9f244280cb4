"""The command surface: one object whose methods are the fourteen commands, each a DataFrame operation underneath."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import InvalidParameter, require
from .functions import bits
from .functions.rng import Xorshift64Star
from .operators import kv, radix, wal
from .operators.cache import ClockCache
from .operators.vector import IvfConfig, IvfIndex
from .schemas import KV_OPS
from .sources.catalog import Catalog

# Commands, the shell's index, and its generator's seed.
COMMANDS = ("kv-insert", "kv-get", "kv-delete", "inspect-pointer", "inspect-arena", "vec-train", "vec-insert", "vec-search", "kvcache-insert", "kvcache-match", "wal-flush", "status", "help", "exit")
#: What each command takes; the others take nothing.
ARGUMENTS = {"kv-insert": "<key> <value>", "kv-get": "<key>", "kv-delete": "<key>", "vec-train": "<samples>", "vec-search": "<top-k>", "kvcache-insert": "<tokens> <kv-offset>"}
DIMENSION, SUB_VECTORS, CENTROIDS, SEED = 64, 4, 16, 0x1A7EF1A7
MOST_VALUE = (1 << 64) - 1


def _number(text: str, what: str) -> int:
    require(text.isdecimal(), f"{what} must be a number")
    return int(text)


@dataclass
class Session:
    spark: SparkSession
    folder: str
    capacity: int = 1 << 16
    arena_bytes: int = 1 << 26
    ops: list[tuple] = field(default_factory=list)
    log: bytes = b""
    flushes: int = 0
    last_tokens: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rng = Xorshift64Star(SEED)
        self.index = IvfIndex(self.spark, IvfConfig(DIMENSION, CENTROIDS, SUB_VECTORS, SEED), Catalog(self.spark, self.folder))
        self.cache = ClockCache(self.capacity)

    def execute(self, line: str) -> str | None:
        """The command's output; None to end. Unknown commands and wrong arguments raise."""
        words = line.split()
        if not words:
            return ""
        name, args = ("exit" if words[0] == "quit" else words[0]), words[1:]
        require(name in COMMANDS, f"unknown command: {name}")
        wanted = ARGUMENTS.get(name, "").split()
        require(bool(wanted) or not args, f"unexpected arguments: {' '.join(args)}")
        require(len(args) == len(wanted), f"usage: {name} {' '.join(wanted)}")
        return None if name == "exit" else getattr(self, name.replace("-", "_"))(*args)

    def _state(self):
        return kv.current(self.spark.createDataFrame(self.ops, KV_OPS))

    def _put(self, op: str, key: str, value: int | None) -> int | None:
        before = self._lookup(key)
        self.ops.append((len(self.ops), op, bytearray(key.encode()), value))
        return before

    def _lookup(self, key: str) -> int | None:
        row = self._state().where(F.col("key") == F.lit(key.encode())).first()
        return None if row is None else int(row["value"])

    def kv_insert(self, key: str, value: str) -> str:
        require(value.isdecimal() and int(value) <= MOST_VALUE, "value must be an unsigned 64-bit number")
        return f"inserted '{key}' = {value} (previous: {self._put('put', key, Decimal(int(value)))})"

    def kv_get(self, key: str) -> str:
        found = self._lookup(key)
        return f"'{key}' not found" if found is None else f"'{key}' = {found}"

    def kv_delete(self, key: str) -> str:
        return f"deleted '{key}': {self._put('del', key, None) is not None}"

    def inspect_pointer(self) -> str:
        """The root's word: the type of a node that has its children, and how many keys it covers as the offset; 0 without keys."""
        root = radix.nodes(self._state()).where("depth = 0").select("family").first()
        if root is None:
            return f"root word: 0x{0:016x}"
        word = bits.pack_pointer(F.lit(bits.NODE_TYPES.index(root["family"])), F.lit(self._state().count()), F.lit(0), F.lit(False), F.lit(0))
        return f"root word: 0x{self.spark.range(1).select(word).first()[0] & MOST_VALUE:016x}"

    def _frontier(self) -> int:
        """Bytes that all insertions and flushes have taken, on eights: what is deleted or replaced gives none back."""
        return sum(-(-(len(key) + 8) // 8) * 8 for _, op, key, _ in self.ops if op == "put") + 8 * self.flushes

    def inspect_arena(self) -> str:
        used = self._frontier()
        return f"arena frontier: {used} of {self.arena_bytes} bytes, {max(self.arena_bytes - used, 0)} left"

    def _vectors(self, n: int):
        rows = [(i, [self.rng.next_f32() for _ in range(DIMENSION)]) for i in range(n)]
        return self.spark.createDataFrame(rows, "id BIGINT, vec ARRAY<FLOAT>")

    def vec_train(self, count: str) -> str:
        require(_number(count, "samples") >= 256, "too few samples to fill a codebook of 256")
        self.index.train(self._vectors(int(count)))
        return f"trained on {count} x {DIMENSION}-dim samples"

    def vec_insert(self) -> str:
        self.index.insert(self._vectors(1).select("vec"))
        return f"inserted vector #{self.index.vector_count()} ({DIMENSION} dims)"

    def vec_search(self, top_k: str) -> str:
        hits = self.index.search(self._vectors(1).withColumnRenamed("id", "query_id"), _number(top_k, "top-k")).orderBy("rank").collect()
        return f"top-{top_k} results: {[(r['id'], float(np.float32(r['distance']))) for r in hits]}"

    def kvcache_insert(self, count: str, offset: str) -> str:
        tokens = [self.rng.next_u64() & 0xFFFF for _ in range(_number(count, "tokens"))]
        self.cache.insert(tokens, _number(offset, "kv-offset"))
        self.last_tokens = tokens
        return f"cached {count} tokens -> offset {offset}"

    def kvcache_match(self) -> str:
        if not self.last_tokens:
            return "nothing is cached so far"
        return f"prefix match: {self.cache.match(self.last_tokens)}"

    def wal_flush(self) -> str:
        """One transaction: an allocation of eight bytes and their content."""
        at, value = 8 * self.flushes, self.rng.next_u64()
        rows = [(0, self.flushes, False, 0, wal.opcode_of("Alloc"), at, bytearray((8).to_bytes(4, "big"))), (0, self.flushes, True, 1, wal.opcode_of("Update"), at, bytearray(value.to_bytes(8, "little")))]
        frames = self.spark.createDataFrame(rows, "log_id BIGINT, tx_id BIGINT, is_parent BOOLEAN, pos INT, opcode TINYINT, offset BIGINT, payload BINARY")
        self.log += bytes(wal.encode_logs(wal.commit_order(frames)).first()["bytes"])
        self.flushes += 1
        return f"flushed tx @ offset {at} ({self.flushes} frames buffered)"

    def status(self) -> str:
        trained = self.index.is_trained
        lines = [f"radix tree   : {self._state().count()} keys, frontier {self._frontier()} of {self.arena_bytes} bytes", f"ivf-pq index : trained={trained} vectors={self.index.vector_count() if trained else 0} (dim {DIMENSION})"]
        lines += [f"kv-cache     : {self.capacity} bytes, {self.cache.grid} slots", f"wal sink     : {self.flushes} frames, {len(self.log)} bytes"]
        return "\n".join(lines)

    def help(self) -> str:
        return "\n".join(COMMANDS)


def run_script(session: Session, lines: list[str]) -> list[str]:
    """The outputs of a script's commands, up to an exit; errors become lines."""
    out = []
    for line in lines:
        try:
            said = session.execute(line)
        except (InvalidParameter, TypeError, ValueError) as e:
            said = f"error: {e}"
        if said is None:
            break
        out.append(said)
    return out
