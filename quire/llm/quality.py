"""Operator 2: quality by weak supervision, in DataFrame functions alone.

Rules look at a document's statistics and vote (1: good, -1: bad) or abstain (0).
Expectation-maximisation estimates, without labels, how often each rule votes bad on
good documents and on bad ones, and how many documents are good; a document's posterior
probability of being good, not the agreement of all rules, decides.

Bad documents are of several kinds, and no rule sees them all: one class for all of them
would settle on the commonest kind and call the others good. So the latent classes are
the good documents and one class for each kind of fault in KINDS. A rule has its own
rate of bad votes in each class. The kinds are anchored by prior beliefs alone (a rule
speaks more often against documents of its own kind), which weigh as much as a hundredth
of the documents and FIRM more, so that they count alike at every size.

A vote pattern is one number (base 3), so all documents are pre-aggregated to at most
3^rules counts, one array in one row; the iterations are a fold over that array, and
the posteriors by pattern go back to documents by an equi-join with that bounded side.

Null text: no words. Texts without words: all counts 0, base_failed. An empty table:
no rows. Rows that repeat a doc_id are documents of their own. Very long texts are one
row each, whole, and their statistics do not depend on length but by what they count.
Other columns, whatever their names, come through ``keep`` as they are. Equal votes have
equal posteriors; one of exactly the threshold is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import Scratch

SPACE = r"[\x20\x09-\x0D]+"
#: A word without a letter.
BARE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])"
#: name: (bad if, good if) over the statistics of ``statistics``; SQL. Between the two, a rule abstains.
RULES = {
    "symbols": ("n_symbols > 0.2 * n_words", "n_symbols <= 0.05 * n_words"),
    "letters": ("n_bare > 0.2 * n_words", "n_bare <= 0.05 * n_words"),
    "lengths": ("word_chars < 3 * n_words or word_chars > 7 * n_words", "word_chars between 4 * n_words and 6.5 * n_words"),
    "capitals": ("n_capitals > 0.3 * word_chars", "n_capitals <= 0.1 * word_chars"),
    "shouts": ("n_shouts > 0.1 * n_words", "n_shouts <= 0.02 * n_words"),
    "repeats": ("n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.02 * n_words"),
    "lines": ("n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0"),
    "stutter": ("n_stutter > 0.1 * n_words", "n_stutter <= 0.03 * n_words"),
    # n_distinct is counted by runs of RUN words: a whole text's share of distinct words falls as it grows, however clean.
    "variety": ("n_words >= 50 and n_distinct < 0.3 * n_words", "n_distinct > 0.45 * n_words"),
    "endings": ("n_endings < 0.5 * n_lines", "n_endings >= 0.9 * n_lines"),
}
#: Kinds of bad documents, and the rules that are made for them.
KINDS = {"marks": ("symbols", "letters", "lengths"), "case": ("capitals", "shouts"), "repetition": ("repeats", "lines", "stutter", "variety"), "shape": ("endings",)}
WINDOW = 8
RUN = 1000
ITERATIONS = 40
#: Before any evidence: the share of good documents (bad ones are shared out evenly over the kinds), and the share of bad
#: votes of a rule on good documents, on those of its own kind, and on those of others.
PRIOR = {"good": 0.9, "on_good": 0.03, "on_own": 0.6, "on_other": 0.1}
#: What the prior weighs: so many documents, and that share of all.
FIRM, FIRM_SHARE = 5.0, 0.01
#: No rate is taken for certain.
LEAST = 0.001
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """_doc, a struct of all columns of docs, and the struct _q of whole-text statistics."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), text.alias("_t"))
    d = d.select("*", F.filter(F.split("_t", SPACE), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    d = d.select("*", F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    # A run of 2k words hashed from its two halves: three passes make windows of eight.
    windows, size = F.col("_h"), 1
    while size < WINDOW:
        ahead = F.greatest(F.size(windows) - size, F.lit(0))
        d = d.select("*", F.zip_with(F.slice(windows, 1, ahead), F.slice(windows, size + 1, ahead), lambda a, b: F.xxhash64(a, b)).alias(f"_w{2 * size}"))
        size *= 2
        windows = F.col(f"_w{size}")
    d = d.withColumnRenamed(f"_w{WINDOW}", "_win")
    # Windows by hash and place, only where some hash stands twice.
    d = d.select("*", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    d = d.select("*", F.size("_s").alias("_k"))

    def twin(x: Column, k: Column) -> Column:
        return ((k > 0) & (F.get("_s", k - 1).h == x.h)) | ((k + 1 < F.col("_k")) & (F.get("_s", k + 1).h == x.h))

    places = F.sort_array(F.transform(F.filter("_s", twin), lambda x: x.i))

    def cover(acc: Column, i: Column) -> Column:
        return F.struct((i + WINDOW).alias("to"), (acc.n + i + WINDOW - F.greatest(i, acc.to)).alias("n"))

    repeated = F.when(F.col("_s").isNull(), 0).otherwise(F.aggregate(places, F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), cover).n)
    kept = lambda pattern: F.length(F.regexp_replace("_t", pattern, "")).cast("long")
    lines = F.size("_l").cast("long")
    runs = F.sequence(F.lit(0), F.floor(F.greatest(F.col("_n") - 1, F.lit(0)) / RUN).cast("int"))
    stats = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        lines.alias("n_lines"),
        kept("[^A-Z]+").alias("n_capitals"),
        kept("[^!]+").alias("n_shouts"),
        F.size(F.filter("_h", lambda h, i: (i > 0) & (F.get("_h", i - 1) == h))).cast("long").alias("n_stutter"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda n, k: n + F.size(F.array_distinct(F.slice("_h", k * RUN + 1, RUN)))).alias("n_distinct"),
        F.regexp_count("_t", F.lit(BARE)).cast("long").alias("n_bare"),
        F.size(F.filter("_l", lambda x: x.rlike(r"[.!?…][\"'»”)]?[\x20\x09-\x0D]*\z"))).cast("long").alias("n_endings"),
    )
    return d.select("_doc", stats.alias("_q"))


def voted(docs: DataFrame) -> DataFrame:
    """_doc and _q of docs, and the number _p of their votes."""
    s = statistics(docs)
    p = F.lit(0)
    for bad, good in reversed(RULES.values()):
        v = F.when(_of(good), 2).when(_of(bad), 0).otherwise(1)
        p = p * 3 + F.when(F.col("_q.n_words") > 0, v).otherwise(1)
    return s.withColumn("_p", p.cast("int"))


def _of(rule: str) -> Column:
    import re

    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"_q.\1", rule))


def _doubles(xs) -> str:
    return f"array({', '.join(f'{x!r}D' for x in xs)})"


def first_guess() -> tuple[list[float], list[list[float]]]:
    """The prior's shares of the classes (good, then KINDS) and each class's rates of bad votes, by rule."""
    shares = [PRIOR["good"], *[(1 - PRIOR["good"]) / len(KINDS)] * len(KINDS)]
    return shares, [[PRIOR["on_good"]] * len(RULES), *([PRIOR["on_own" if r in own else "on_other"] for r in RULES] for own in KINDS.values())]


#: SQL over x (a pattern, with its votes x.v) and m (shares m.pi, rates m.r): the posteriors of the classes.
_LOG = f"""transform(sequence(0, {len(KINDS)}), k -> aggregate(sequence(0, {len(RULES) - 1}), ln(m.pi[k]), (a, j) ->
    a + CASE x.v[j] WHEN 1 THEN ln(1 - m.r[k][j]) WHEN -1 THEN ln(m.r[k][j]) ELSE 0D END))"""
_CLASSES = f"element_at(transform(array({_LOG}), l -> element_at(transform(array(transform(l, z -> exp(z - array_max(l)))), e -> transform(e, z -> z / aggregate(e, 0D, (a, y) -> a + y))), 1)), 1)"


def learnt(counts: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Of counts (_p int, n long) one row: ps, the patterns with their votes, and m, the learnt shares (pi) and rates (r)."""
    m = len(RULES)
    row = counts.agg(F.array_sort(F.collect_list(F.struct("_p", F.col("n").cast("double").alias("n")))).alias("c"))
    digits = f"transform(sequence(0, {m - 1}), j -> cast(floor(x._p / power(3, j)) as int) % 3 - 1)"
    row = row.select(F.expr(f"transform(c, x -> named_struct('p', x._p, 'n', x.n, 'v', {digits}))").alias("ps"))
    row = row.withColumn("all", F.expr("aggregate(ps, 0D, (a, x) -> a + x.n)")).withColumn("w", F.lit(FIRM) + F.lit(FIRM_SHARE) * F.col("all"))
    shares, rates = first_guess()
    pi0, r0 = _doubles(shares), f"array({', '.join(map(_doubles, rates))})"
    # E: each pattern's documents by class. M: shares and rates of bad votes among those given, with the prior's weight.
    e_step = f"transform(ps, x -> named_struct('v', x.v, 'q', transform({_CLASSES}, y -> y * x.n)))"
    total = lambda what: f"aggregate(e, 0D, (a, y) -> a + {what})"
    pi = f"transform({pi0}, (s, k) -> ({total('y.q[k]')} + w * s) / (all + w))"
    rate = f"({total('IF(y.v[j] = -1, y.q[k], 0D)')} + w * s) / ({total('IF(y.v[j] <> 0, y.q[k], 0D)')} + w)"
    r = f"transform({r0}, (own, k) -> transform(own, (s, j) -> least({1 - LEAST}D, greatest({LEAST}D, {rate}))))"
    m_step = f"element_at(transform(array({e_step}), e -> named_struct('pi', {pi}, 'r', {r})), 1)"
    return row.select("ps", F.expr(f"aggregate(sequence(1, {iterations}), named_struct('pi', {pi0}, 'r', {r0}), (m, t) -> {m_step})").alias("m"))


def posteriors(counts: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """_p, quality for the patterns in counts (_p int, n long): one row in, by one expression, to one row a pattern out."""
    return learnt(counts, iterations).select(F.expr(f"inline(transform(ps, x -> named_struct('_p', x.p, 'quality', ({_CLASSES})[0])))"))


def _judged(scratch: Scratch, v: DataFrame, threshold: float) -> DataFrame:
    found = scratch.write(posteriors(v.groupBy("_p").agg(F.count("*").alias("n"))), "posteriors")
    base = (F.col("_q.n_words") < 20) | (100 * F.col("_q.n_repeat_words") > 30 * F.col("_q.n_words"))
    # At most 3^rules rows.
    return v.join(F.broadcast(found), "_p").withColumn("base_failed", base).withColumn("kept", ~base & (F.col("quality") >= threshold))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, quality (posterior probability)."""
    scratch = Scratch(docs.sparkSession, "quality")
    v = scratch.write(voted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("_doc", F.col("_doc").dropFields("text")), "votes")
    return _judged(scratch, v, threshold).select("_doc.doc_id", *(f"_q.{s}" for s in _STATS), "base_failed", "kept", "quality")


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with its columns."""
    scratch = Scratch(docs.sparkSession, "quality")
    v = scratch.write(voted(docs), "votes")
    return _judged(scratch, v, threshold).where("kept").select("_doc.*")


def op2(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged(docs)
