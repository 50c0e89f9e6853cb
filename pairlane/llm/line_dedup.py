"""Line dedup by winnowing over line hashes (DataFrame functions only).

A *window* starts at every non-blank line and grows until it has ``WINDOW`` lines or
``LONG_WORDS`` words, so one long paragraph is a window by itself. The line with the
smallest hash in a window is its fingerprint: equal windows pick equal fingerprints, so
whatever is repeated over a window's length is sure to share one.

1. Only fingerprints (hash, document, position) are shuffled, about one for two lines;
   those that occur once leave.
2. The windows that picked a repeated fingerprint are joined to the first position of their
   content (a grouped minimum, never pairs of occurrences). A window that stands later is a
   *match* with one source position.
3. A match knows the lines next to its window at both places. Matches of one source, one distance
   and consecutive lines are chained; most chains end at a difference on either side.
   A chain that goes on is grown: both texts have hashes of 1, 2, 4, ... lines from each line on, and
   a binary descent over these finds the next difference above and below, in steps that grow
   with the logarithm of the reach, not with the reach. Chains of the same two texts share one row.
4. What the grown matches cover is merged into runs, and the runs are deleted.

The first occurrence of a line is never deleted, as each deleted line has an equal one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlane.llm.common import cut, named, others, read, saved

WINDOW = 3
LONG_WORDS = 50


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _lines(text: Column) -> Column:
    """struct(line, words, digest) of each line with a word; white space within a line does not count."""
    plain = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    words = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    item = lambda x, i: F.when(x != "", F.struct(i.alias("line"), words(x).alias("words"), _digest(x).alias("digest")))
    return F.filter(F.transform(plain, item), lambda x: x.isNotNull())


def _window(lines: Column, i: Column, window: int, long_words: int) -> Column:
    """struct(s, n, place, gram) of the window at line ``i`` of ``lines``; n is 0 where the text ends before it is full."""

    def grow(s: Column, k: Column) -> Column:
        longer = F.struct((s["n"] + 1).alias("n"), (s["words"] + F.coalesce(F.get(lines, i + k)["words"], F.lit(-1 << 30))).alias("words"))
        return F.when((s["n"] < window) & s["words"].between(0, long_words - 1), longer).otherwise(s)

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
    size = F.aggregate(F.sequence(F.lit(0), F.lit(window - 1)), zero, grow, lambda s: F.when(s["words"] >= 0, s["n"]).otherwise(0))

    def full(w: Column) -> Column:
        part = w["part"]
        gram = F.concat(*[F.coalesce(F.get(part, F.lit(k)), F.lit(b"")) for k in range(window)])
        return F.struct(w["s"].alias("s"), w["n"].alias("n"), (w["s"] + F.array_position(part, F.array_min(part)).cast("int") - 1).alias("place"), gram.alias("gram"))

    # arrays of one element name what is used more than once
    # single elements are taken, as slice() copies the whole array
    own = lambda n: F.filter(F.array(*[F.when(n > k, F.get(lines, i + k)["digest"]) for k in range(window)]), lambda x: x.isNotNull())
    sized = F.transform(F.array(size), lambda n: F.struct(i.alias("s"), n.alias("n"), own(n).alias("part")))
    return F.get(F.transform(sized, full), F.lit(0))


def _matches(lines: DataFrame, window: int, long_words: int) -> DataFrame:
    """Each window of a text (lines ``s`` to ``e``) whose content stands first elsewhere, where (``row0``, ``s0``), and whether the lines above and below it agree."""
    starts = F.sequence(F.lit(0), F.size("lines") - 1)
    places = F.array_distinct(F.transform(F.filter(F.transform(starts, lambda i: _window(F.col("lines"), i, window, long_words)), lambda w: w["n"] > 0), lambda w: w["place"]))
    prints = lines.select("row", F.col("lines"), F.explode(places).alias("place")).select("row", "place", F.get("lines", F.col("place"))["digest"].alias("mark"))
    prints = cut(prints)
    # both sides of the joins stand on plain exchanges, so a very common line's rows can be split
    marks = cut(prints.groupBy("mark").count().where("count > 1").select("mark"))
    repeated = prints.join(marks, "mark", "left_semi").groupBy("row").agg(F.collect_set("place").alias("places"))
    # the few starts from which a window can pick a place
    near = lambda p: F.filter(F.transform(F.sequence(F.greatest(p - (window - 1), F.lit(0)), p), lambda i: _window(F.col("lines"), i, window, long_words)), lambda w: (w["n"] > 0) & (w["place"] == p))
    line = lambda i: F.get("lines", i)
    with_ends = lambda w: F.struct(
        w["s"].alias("s"), (w["s"] + w["n"] - 1).alias("e"), F.md5(w["gram"]).alias("gram"), line(w["s"])["line"].alias("start"), line(w["s"] + w["n"] - 1)["line"].alias("end"),
        line(w["s"] - 1)["digest"].alias("above"), line(w["s"] + w["n"])["digest"].alias("below"),
    )
    picked = lines.join(repeated, "row").select("row", "doc", F.explode(F.transform(F.flatten(F.transform("places", near)), with_ends)).alias("w"))
    windows = cut(picked.select("row", F.struct("doc.*", F.col("w.s").alias("s")).alias("here"), "w.e", "w.gram", "w.start", "w.end", "w.above", "w.below"))
    first = windows.groupBy("gram").agg(F.min(F.struct("here", "row", "above", "below")).alias("first"), F.max("here").alias("last")).where("first.here < last").drop("last")
    found = windows.join(cut(first), "gram").where("here > first.here")
    return found.select(
        "row", F.struct("here.n", "here.k", "here.m").alias("doc"), "here.s", "e", "start", "end", F.col("first.row").alias("row0"), F.col("first.here.s").alias("s0"),
        F.coalesce(F.expr("above = first.above"), F.lit(False)).alias("up"), F.coalesce(F.expr("below = first.below"), F.lit(False)).alias("down"),
    )


def _chains(matches: DataFrame) -> DataFrame:
    """Matches with one source text at one distance and on consecutive lines, as one row."""
    shift = F.col("s") - F.col("s0")
    nth = F.row_number().over(Window.partitionBy("row", "row0", "shift").orderBy("s"))
    runs = matches.withColumn("shift", shift).withColumn("chain", F.col("s") - nth)
    ends = [F.min("s").alias("s"), F.max("e").alias("e"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("up", "s").alias("up"), F.max_by("down", "s").alias("down")]
    return runs.groupBy("doc", "row", "row0", "shift", "chain").agg(*ends).drop("chain")


def _levels(lines: Column) -> Column:
    """levels[k][i]: hash of the 2**k lines from line i on."""

    def next_level(levels: Column, k: Column) -> Column:
        last, half = F.element_at(levels, -1), F.pow(F.lit(2), k - 1).cast("int")
        double = F.transform(F.sequence(F.lit(0), F.size(last) - half - 1), lambda i: F.xxhash64(F.get(last, i), F.get(last, i + half)))
        return F.when(F.size(last) > half, F.concat(levels, F.array(double))).otherwise(levels)

    first = F.array(F.transform(lines, lambda x: F.xxhash64(x["digest"])))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(lines) + F.lit(1))).cast("int")), first, next_level)


def _reach(own: Column, other: Column, i: Column, j: Column, below: bool) -> Column:
    """How many lines from ``i`` and ``j`` on (below) or before them (above) agree."""

    def step(t: Column, k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("int")
        at = t if below else -t - size
        return F.when(F.get(F.get(own, k), i + at) == F.get(F.get(other, k), j + at), t + size).otherwise(t)

    return F.aggregate(F.sequence(F.size(own) - 1, F.lit(0)), F.lit(0), step)


def _grown(chains: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, start, end) of the chains that go on above or below, grown to the next difference on either side."""
    more = cut(chains.where("up OR down").select("doc", "row", "row0", F.struct("s", "e", "shift", "up", "down").alias("c")))
    rows = more.select("row").union(more.select("row0")).distinct()
    texts = cut(lines.join(rows, "row", "left_semi").select("row", F.transform("lines", lambda x: x["line"]).alias("numbers"), _levels(F.col("lines")).alias("levels")))
    pairs = more.groupBy("doc", "row", "row0").agg(F.collect_list("c").alias("chains"))
    both = pairs.join(texts, "row").join(texts.select(F.col("row").alias("row0"), F.col("levels").alias("other")), "row0")

    def grow(c: Column) -> Column:
        above = F.when(c["up"], _reach(F.col("levels"), F.col("other"), c["s"], c["s"] - c["shift"], False)).otherwise(0)
        below = F.when(c["down"], _reach(F.col("levels"), F.col("other"), c["e"] + 1, c["e"] + 1 - c["shift"], True)).otherwise(0)
        return F.struct(F.get("numbers", c["s"] - above).alias("start"), F.get("numbers", c["e"] + below).alias("end"))

    return both.select("doc", F.explode(F.transform("chains", grow)).alias("span")).select("doc", "span.start", "span.end")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(key, text_md5, runs): line runs [start, end] of each text that repeat something earlier."""
    doc = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), _digest(F.coalesce(F.col(text), F.lit(""))).alias("m"))
    lines = docs.select(doc.alias("doc"), _lines(F.col(text)).alias("lines")).where(F.size("lines") > 0)
    lines = saved(lines.select(F.monotonically_increasing_id().alias("row"), "doc", "lines"))
    chains = cut(_chains(_matches(lines, window, long_words)))
    spans = cut(chains.select("doc", "start", "end").union(_grown(chains, lines)).select("doc.n", "doc.k", "doc.m", "start", "end"))
    # a span that starts beyond all spans before it opens a run
    by = Window.partitionBy("n", "k", "m").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.distinct().withColumn("opens", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("n", "k", "m", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("n", "k", "m").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    return runs.select(F.col("k").alias("key"), F.col("m").alias("text_md5"), "runs")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """Delete later repeats of line runs; adds ``removed_runs`` and ``removed_lines`` to the columns of ``docs``.

    A window that has stood at an earlier place (in a document with a smaller key, NULL keys
    last, or above in the same one) is a match with the first such place, and goes with
    all lines around it that equal those around that place. Lines are compared without
    outer and repeated white space; blank lines are skipped, and go only within a run. Documents that
    agree in key and text are one document: they get the same result and are no repeats of each other.
    NULL text stays NULL. An empty table gives no rows. The added names replace columns so
    called; all other columns stay.
    """
    kept = others(docs, "removed_runs", "removed_lines")
    rest = F.struct(F.lit(0).alias("__pairlane_row"), *[named(c) for c in kept if c != text])  # never empty
    rows = docs.select(rest.alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), _digest(F.coalesce(F.col(text), F.lit(""))).alias("md5"))
    runs = repeated_runs(docs, key, text, window, long_words).withColumnsRenamed({"key": "of_key", "text_md5": "of_md5"})
    joined = rows.join(runs, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("md5") == F.col("of_md5")), "left")
    joined = joined.withColumn("parts", F.when(F.col("runs").isNotNull(), F.split("text", "\n")))

    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"])))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), gone)
    left = F.transform(stay, lambda i: F.get("parts", i))
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"] + 1)
    return joined.select(
        *[F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept],
        F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")).alias("removed_runs"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("removed_lines"),
    )


def op5_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "removed_lines", F.size("removed_runs").cast("long").alias("removed_runs"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS line FROM d),
p AS (SELECT *, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain FROM l),
f AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i, md5(plain) AS h, len(string_split(plain, ' ')) AS words FROM p WHERE plain <> ''),
g AS (
  SELECT doc_id, i, h, words, lead(h, 1) OVER w AS h1, lead(h, 2) OVER w AS h2, lead(words, 1) OVER w AS w1
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), n AS (
  SELECT doc_id, i AS s, CASE WHEN words >= {LONG_WORDS} THEN h WHEN words + w1 >= {LONG_WORDS} THEN h || h1 ELSE h || h1 || h2 END AS gram FROM g
), r AS (
  SELECT doc_id, s, first_value(doc_id) OVER w AS d0, first_value(s) OVER w AS s0 FROM n WHERE gram IS NOT NULL WINDOW w AS (PARTITION BY gram ORDER BY doc_id, s)
), hit AS (
  SELECT doc_id, s, d0, s - s0 AS shift FROM r WHERE doc_id <> d0 OR s <> s0
), eq AS (
  SELECT q.*, a.i, a.line, a.i - row_number() OVER (PARTITION BY q.doc_id, q.d0, q.shift ORDER BY a.i) AS island
  FROM (SELECT DISTINCT doc_id, d0, shift FROM hit) q JOIN f a ON a.doc_id = q.doc_id JOIN f b ON b.doc_id = q.d0 AND b.i = a.i - q.shift AND b.h = a.h
), span AS (
  SELECT eq.doc_id, min(eq.line) AS s, max(eq.line) AS e FROM eq LEFT JOIN hit ON hit.doc_id = eq.doc_id AND hit.d0 = eq.d0 AND hit.shift = eq.shift AND hit.s = eq.i
  GROUP BY eq.doc_id, eq.d0, eq.shift, eq.island HAVING count(hit.s) > 0
), gone AS (
  SELECT DISTINCT p.doc_id, p.line FROM p JOIN span ON p.doc_id = span.doc_id AND p.line BETWEEN span.s AND span.e
), k AS (
  SELECT p.doc_id, p.line, p.raw, gone.line IS NOT NULL AS away FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.line = gone.line
), e AS (
  SELECT *, away AND NOT coalesce(lag(away) OVER (PARTITION BY doc_id ORDER BY line), false) AS opens FROM k
)
SELECT doc_id, (count(*) FILTER (away))::BIGINT AS removed_lines, (count(*) FILTER (opens))::BIGINT AS removed_runs,
       length(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT away), ''))::BIGINT AS kept_chars,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT away), '')) AS kept_sha256
FROM e GROUP BY doc_id
"""

QUERIES = {"op5_winnow_lines": op5_winnow_lines}
ORACLES = {"op5_winnow_lines": OP5_SQL}
