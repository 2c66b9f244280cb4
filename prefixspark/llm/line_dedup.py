"""Line dedup by a deletion-neighbourhood join. DataFrame functions only.

Lines are compared as words (lower case, split at white space). Two lines are equal if their words are. They are near if
one insertion, deletion or substitution of a unit turns one into the other. A line of ``min_words`` words or more has its
words as units; a shorter one of ``min_chars`` characters or more (words joined by a space) has its characters; two lines of
different units are not near. Shorter lines still match if equal. A line goes if an equal or near line starts earlier in the
corpus (by doc_id, then line number); lines without words stay. Near duplicates are found in these steps:

1. lines become hashes; equal ones are summed, the earliest kept;
2. a near pair shares the first or the last n // 2 units of its shorter line, so only lines that share such a half
   go on (nothing is lost);
3. each emits its units' hash and, for every place, the hash without that unit; these are exclusive-or sums of
   hashes of (unit, place), so a window function yields all of a line's variants in one sorted run;
4. equal variants are joined: two lines that are equal without the same place differ by a substitution there; a line that equals
   another's variant lacks one unit of it. Groups are summed to their earliest member, never paired out;
5. the earliest partner's edit distance is verified on the units themselves. Where hashes collided, it fails; the line then
   meets every earlier line of its variants, each verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop_scratch, free_name, materialise, scratch_mark, text_of

MIN_WORDS = 8
#: One character in so many: "page 1" and "page 2" are different lines.
MIN_CHARS = 24
#: A line that starts so often, or more often in large tables, is hot.
HOT_LINE = 1000


def words_of(line: Column) -> Column:
    """A split at one plain character needs no regular expression for each row; other white space becomes one first."""
    return F.filter(F.split(F.regexp_replace(F.lower(line), r"[\t\x0B\f\r]", " "), " "), lambda w: w != "")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, line_no, line) of lines with words. The text is split before it is exploded, so no row carries it."""
    text = text_of(text_col)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.split(text, "\n", -1).alias("lines"))
    return whole.select("doc_id", "t", F.posexplode("lines").alias("line_no", "line")).where(F.col("line").rlike(r"[^ \t\x0B\f\r]"))


def units_of(words: Column, min_words: int, min_chars: int) -> Column:
    """What an edit changes: the words, or the characters of a line of few words behind two marks that no word equals (so that
    it is two edits from any words), or nothing where a line matches only if equal."""
    joined = F.array_join(words, " ")
    letters = F.concat(F.array(F.lit("\n"), F.lit("\n")), F.filter(F.split(joined, ""), lambda c: c != ""))
    return F.when(F.size(words) >= min_words, words).when(F.length(joined) >= min_chars, letters).otherwise(F.array().cast("array<string>"))


def line_hashes(words: Column) -> list[Column]:
    return [F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(3), words).alias("h2")]


def _halves(words: Column) -> Column:
    """Hashes of the first and last n // 2 and (n - 1) // 2 words, marked by side."""
    n = F.size(words)
    a, b = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    keys = [F.xxhash64(F.lit(side), F.slice(words, F.lit(1) if side == 0 else n - k + 1, k)) for k in (a, b) for side in (0, 1)]
    return F.array_distinct(F.array(*keys))


def _letter_halves(words: Column) -> Column:
    """The same of the characters of a line of few words."""
    text = F.array_join(words, " ")
    n = F.length(text)
    a, b = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    keys = [F.xxhash64(F.lit(side), F.substring(text, F.lit(1) if side == 2 else n - k + 1, k)) for k in (a, b) for side in (2, 3)]
    return F.array_distinct(F.array(*keys))


def halves_of(words: Column, min_words: int, min_chars: int) -> Column:
    letters = F.when(F.length(F.array_join(words, " ")) >= min_chars, _letter_halves(words)).otherwise(F.array().cast("array<long>"))
    return F.when(F.size(words) >= min_words, _halves(words)).otherwise(letters)


def one_word_apart(x: Column, y: Column) -> Column:
    """Word edit distance of two arrays is at most one."""
    n, m = F.size(x), F.size(y)
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    ahead = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.least(n, m))
    back = F.zip_with(F.reverse(x), F.reverse(y), lambda a, b: F.coalesce(a == b, F.lit(False)))
    behind = F.coalesce(F.nullif(F.array_position(back, False), F.lit(0)) - 1, F.least(n, m))
    return (F.abs(n - m) <= 1) & (ahead + behind >= F.greatest(n, m) - 1)


def near_lines(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, min_words: int, min_chars: int) -> DataFrame:
    """(h1, h2) of distinct lines with an earlier near line. ``distinct``: h1, h2, pos (doc_id, line_no, t), halves."""
    halves = distinct.where(F.size("halves") > 0).select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("half")
    passed = halves.join(shared, "half").select("h1").distinct()
    at = distinct.join(passed, "h1").select("h1", "h2", "pos")
    wanted = at.groupBy(F.col("pos.doc_id").alias("p_id"), F.col("pos.t").alias("p_t")).agg(F.collect_list(F.struct(F.col("pos.line_no").alias("line_no"), "h1", "h2")).alias("wanted"))
    text = text_of(text_col)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    met = whole.join(wanted, (F.col("t") == F.col("p_t")) & F.col("doc_id").eqNullSafe(F.col("p_id"))).select("doc_id", "t", "wanted", F.split("text", "\n", -1).alias("lines"))
    # only the wanted lines are exploded; a second use of "lines" keeps its split out of the lambda
    picked = F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["line_no"].alias("line_no"), F.get("lines", w["line_no"]).alias("line")))
    met = met.select("doc_id", "t", F.when(F.size("lines") > 0, picked).alias("picked")).select("doc_id", "t", F.explode("picked").alias("l"))
    met = met.select("l.h1", "l.h2", F.struct("doc_id", "l.line_no", "t").alias("pos"), words_of(F.col("l.line")).alias("words"))
    met = met.dropDuplicates(["h1", "h2"])
    spark, since = docs.sparkSession, scratch_mark()
    lines = materialise(met.select("h1", "h2", "pos", units_of(F.col("words"), min_words, min_chars).alias("words")), "line-words")

    # from here to the verification a line is its first hash
    exploded = lines.select("h1", "words").repartition("h1").select("h1", F.posexplode("words").alias("i", "word"))
    exploded = exploded.select("h1", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("left"))
    by = Window.partitionBy("h1").orderBy("i")
    before = F.coalesce(F.bit_xor("here").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_left = F.bit_xor("left").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto_left = F.bit_xor("left").over(by.rowsBetween(Window.unboundedPreceding, 0))
    variants = exploded.select("h1", "i", before.bitwiseXOR(all_left).bitwiseXOR(upto_left).alias("key"))
    sums = exploded.groupBy("h1").agg(F.bit_xor("here").alias("key")).select("h1", F.lit(-1).alias("i"), "key")
    emitted = materialise(variants.unionByName(sums), "line-variants")
    keys = emitted.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("key")
    met = emitted.join(keys, "key").join(distinct.select("h1", "pos"), "h1")
    met = materialise(met.select("key", "i", "pos"), "line-met")
    drop_scratch(spark, since, keep=("line-words", "line-met"))
    at_place = met.where("i >= 0").groupBy("key", "i").agg(F.min("pos").alias("partner"))
    wholes = met.where("i < 0").groupBy("key").agg(F.min("pos").alias("partner"))
    lacking = met.where("i >= 0").groupBy("key").agg(F.min("pos").alias("partner"))
    found = met.where("i >= 0").join(at_place, ["key", "i"]).select("pos", "partner")
    found = found.unionByName(met.where("i >= 0").join(wholes, "key").select("pos", "partner"))
    found = found.unionByName(met.where("i < 0").join(lacking, "key").select("pos", "partner"))
    pairs = found.where(F.col("partner") < F.col("pos")).groupBy("pos").agg(F.min("partner").alias("partner"))
    theirs = lines.select(F.col("pos").alias("partner"), F.col("words").alias("other"))
    judge = lambda p: p.join(lines, "pos").join(theirs, "partner").withColumn("ok", one_word_apart(F.col("words"), F.col("other")))
    judged = materialise(judge(pairs).select("pos", "h1", "h2", "ok"), "line-judged")
    failed = judged.where("NOT ok").select("pos")
    out = judged.where("ok").select("h1", "h2")
    if failed.isEmpty():
        drop_scratch(spark, since, keep="line-judged")
        return out
    # keys collided: those lines meet all earlier lines of their keys
    mine = met.join(failed, "pos").select("key", "pos")
    every = mine.join(met.select("key", F.col("pos").alias("partner")), "key").where("partner < pos").select("pos", "partner").distinct()
    return out.unionByName(judge(every).where("ok").select("h1", "h2").distinct())


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t, n_equal, n_near, dropped): for each text with lines that go, how many and their numbers from 0. ``t`` is the
    text's xxhash64, so rows that share an id but not a text stay apart."""
    lines = lines_of(docs, id_col, text_col).select("doc_id", "t", "line_no", words_of(F.col("line")).alias("words"))
    lines = materialise(lines.select("doc_id", "t", "line_no", *line_hashes(F.col("words")), halves_of(F.col("words"), min_words, min_chars).alias("halves")), "lines")
    pos = F.struct("doc_id", "line_no", "t")
    distinct = materialise(lines.groupBy("h1", "h2").agg(F.min(pos).alias("pos"), F.first("halves").alias("halves"), F.count("*").alias("n")), "lines-distinct")
    near = near_lines(docs, distinct, id_col, text_col, min_words, min_chars).withColumn("near", F.lit(True))
    verdict = distinct.select("h1", "h2", "pos", "n").join(near, ["h1", "h2"], "left").select("h1", "h2", "pos", "n", F.coalesce("near", F.lit(False)).alias("near"))
    verdict = materialise(verdict.where("n > 1 OR near"), "lines-verdict")
    rows = lines.select("doc_id", "t", "line_no", "h1", "h2")
    # lines that start very often meet their verdict by broadcast: at most BROADCAST_ROWS lines can start that often
    often = F.col("n") >= max(HOT_LINE, -(-lines.count() // BROADCAST_ROWS))
    hot = F.broadcast(verdict.where(often))
    usual = rows.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(verdict.where(~often), ["h1", "h2"])
    judged = rows.join(hot, ["h1", "h2"]).unionByName(usual)
    judged = judged.withColumn("equal", pos > F.col("pos")).where("equal OR near").select("doc_id", "t", "line_no", "near").distinct()
    return judged.groupBy("doc_id", "t").agg(F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"), F.sort_array(F.collect_list("line_no")).alias("dropped"))


def _found(docs: DataFrame, id_col: str, text_col: str, min_words: int, min_chars: int) -> DataFrame:
    """``duplicate_lines`` as a table; its own scratch tables go."""
    since = scratch_mark()
    found = materialise(duplicate_lines(docs, id_col, text_col, min_words, min_chars), "lines-dropped")
    drop_scratch(docs.sparkSession, since, keep="lines-dropped")
    return found


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_equal, n_near, n_kept, dropped (line numbers).

    Null texts count as empty: one line without words, which stays. Very long texts and lines are compared whole. Rows that
    repeat a document (id and text) are one document: equal places keep equal lines. Ties between texts of one id and line
    number go by the text's hash. Null ids come before all others. An empty table gives an empty table. Other columns are
    not read.
    """
    found = _found(docs, id_col, text_col, min_words, min_chars)
    text = text_of(text_col)
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"))
    f = found.select(F.col("doc_id").alias("d"), F.col("t").alias("d_t"), "n_equal", "n_near", "dropped")
    joined = each.join(f, (F.col("t") == F.col("d_t")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    n_equal, n_near = F.coalesce("n_equal", F.lit(0)).cast("long"), F.coalesce("n_near", F.lit(0)).cast("long")
    return joined.select("doc_id", "n_lines", n_equal.alias("n_equal"), n_near.alias("n_near"), (F.col("n_lines") - n_equal - n_near).alias("n_kept"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the duplicate lines cut from its text column; all other columns and all rows stay, whatever their names.
    Texts that lose nothing stay as they are (nulls too); one that loses all its lines becomes empty. Repeated rows, ties, null
    ids and long texts: as in ``line_report``. An empty table gives an empty table."""
    found = _found(docs, id_col, text_col, min_words, min_chars)
    d_id, d_t, dropped, lines = (free_name(docs, n) for n in ("d_id", "d_t", "dropped", "lines"))
    f = found.select(F.col("doc_id").alias(d_id), F.col("t").alias(d_t), F.col("dropped").alias(dropped))
    joined = docs.join(f, (F.xxhash64(text_of(text_col)) == F.col(d_t)) & F.col(id_col).cast("long").eqNullSafe(F.col(d_id)), "left")
    # two uses of the lines keep their split out of the lambda
    joined = joined.withColumn(lines, F.split(text_of(text_col), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    cut = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return joined.withColumn(text_col, F.when(F.col(dropped).isNull(), F.col(text_col)).otherwise(cut)).select(*(F.col(f"`{c}`") for c in docs.columns))
