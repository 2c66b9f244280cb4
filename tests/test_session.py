import pytest

from prefixspark.errors import InvalidParameter
from prefixspark.operators.wal import parse_frames
from prefixspark.session import COMMANDS, Session, run_script


@pytest.fixture
def session(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}")


def test_keyed_commands(session):
    out = run_script(session, ["kv-insert a 1", "kv-insert a 18446744073709551615", "kv-get a", "kv-get b", "kv-delete a", "kv-delete a", "kv-insert a x", "kv-get", "inspect-pointer", "inspect-arena", "exit", "kv-get a"])
    assert out[:6] == ["inserted 'a' = 1 (previous: None)", "inserted 'a' = 18446744073709551615 (previous: 1)", "'a' = 18446744073709551615", "'b' not found", "deleted 'a': True", "deleted 'a': False"]
    assert out[6].startswith("error") and out[7] == "error: usage: kv-get <key>" and out[8] == "root word: 0x0000000000000000" and len(out) == 10
    assert out[9] == "arena frontier: 32 of 67108864 bytes, 67108832 left"  # what is deleted gives nothing back


def test_wrong_arguments(session):
    for line, said in {"kv-insert": "usage", "kv-insert a": "usage", "kv-get a b": "usage", "vec-train": "usage", "kvcache-insert 3": "usage", "exit now": "unexpected", "status x": "unexpected", "help x": "unexpected", "vec-train many": "number", "kvcache-insert x 1": "number", "vec-train 255": "256"}.items():
        with pytest.raises(InvalidParameter, match=said):
            session.execute(line)
    assert session.execute("exit") is None and session.execute("quit") is None


def test_the_roots_word_follows_its_children(session):
    for key in ("0", "P", "`", "p"):  # four first half bytes
        session.execute(f"kv-insert {key} 1")
    word = int(session.execute("inspect-pointer").split("0x")[1], 16)
    assert (word & 7, word >> 3 & ((1 << 40) - 1)) == (2, 4)
    session.execute("kv-insert @ 1")
    word = int(session.execute("inspect-pointer").split("0x")[1], 16)
    assert (word & 7, word >> 3 & ((1 << 40) - 1)) == (3, 5)


def test_cache_log_and_help(session):
    out = run_script(session, ["kvcache-match", "kvcache-insert 5 77", "kvcache-match", "wal-flush", "wal-flush", "help", "", "quit"])
    assert out[0] == "nothing is cached so far" and out[2] == "prefix match: (5, 77)"
    assert out[5].split("\n") == list(COMMANDS) and len(COMMANDS) == 14 and len(out) == 7
    assert [(op, at) for op, at, _ in parse_frames(session.log)] == [(0, 0), (2, 0), (0, 8), (2, 8)]
    said = session.execute("status")
    assert "frontier 16 of 67108864 bytes" in said and "kv-cache     : 65536 bytes, 8192 slots" in said and "wal sink     : 2 frames, 80 bytes" in said


def test_vector_commands(session):
    out = run_script(session, ["vec-search 3", "vec-train 10", "vec-train 256", "vec-insert", "vec-insert", "vec-search 1", "status"])
    assert out[0].startswith("error") and out[1].startswith("error")
    assert out[2] == "trained on 256 x 64-dim samples" and out[4] == "inserted vector #2 (64 dims)"
    assert "trained=True vectors=2" in out[6]


def test_unknown_command(session):
    with pytest.raises(InvalidParameter):
        session.execute("fly")
