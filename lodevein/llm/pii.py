"""Personal data by bootstrapped contextual extraction, with DataFrame functions alone.

Base patterns give the seeds: e-mail and IP addresses, card and phone numbers.  Words around a place are its lexical
patterns: up to two to the left and two to the right, one of each side, and the farther ones with a gap.  Patterns and instances (seeds, and
other words with a digit or an at sign) form a graph that is scored in generations.  The score of a pattern for a kind is what is
certain at 95 % (the lower Wilson bound) about the share of believed instances of that kind among the distinct instances that
stand in its slot, of which those that nothing is known of count ``doubt``; patterns with the belief of ``least_seeds`` instances and ``least_score`` are accepted.  The belief in an unseen
instance is that of a noisy-or over its accepted patterns; believed instances support further patterns in the next
generation, until no pattern comes or goes.  Places around which accepted patterns stand that give a belief of ``LEAST_BELIEF``
are added as spans.

Spans are code points, end exclusive.  Base matches are leftmost and don't overlap within a kind; what fails its test is
dropped and not tried again.  Possessive and look-behind forms of the patterns find the same matches in linear time
and without recursion.

Defined results: a null text is empty; rows of null or repeated ids are reported as they come; of kinds that claim one place
that of the largest belief has it, then the last by name; very long texts are read whole (64 code points to each side make a context); an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevein.llm.common import settle

#: Kinds in order and what finds their matches.
_LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = {
    # Every start within a run of local characters ends alike, so only the first is tried: at the run's start or behind a match.
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Maximal runs of digits with single separators; only those of 16 to 19 digits can pass.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A word that holds a digit or an at sign.
_SPACE = r"\x20\x09-\x0D"
CANDIDATE = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"

GENERATIONS = 4
LEAST_SEEDS = 4
LEAST_SCORE = 0.5
#: Belief, by a noisy-or over its accepted patterns, that makes a place a span.
LEAST_BELIEF = 0.9
#: How much an instance that nothing is known of counts against a pattern.
DOUBT = 0.5
#: Code points to each side of a place that can be context, and matches whose places are counted together.
CONTEXT = 64
GATHER = 64


def _luhn(digits: Column) -> Column:
    place = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(place, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return _luhn(F.regexp_replace(m, r"[\x20-]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda s: _passes(kind, s["token"])


def _apart(kind: str):
    return lambda w: ~F.exists(kind, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))


_SPAN = "array<struct<start:long,end:long,token:string,before:string,after:string>>"


def _words(side: Column) -> Column:
    """Words in lower case; those that could be instances are all alike."""
    found = F.filter(F.split(F.lower(side), rf"[{_SPACE}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.when(w.rlike("[0-9@]"), "#").otherwise(w))


def _around(before: Column, after: Column) -> Column:
    """Two words before a place and two behind it; # where another instance, or an end of the text, is nearer."""
    none = F.array(F.lit("#"), F.lit("#"))
    left = F.reverse(_words(before))
    right = _words(F.regexp_replace(after, rf"^[^{_SPACE}]+", ""))
    return F.concat(F.reverse(F.slice(F.concat(left, none), 1, 2)), F.slice(F.concat(right, none), 1, 2))


def _sum(x: Column, first: Column) -> Column:
    """Sum of the first numbers of an array."""
    return F.aggregate(F.slice(x, 1, first), F.lit(0).cast("long"), lambda a, v: a + v)


def matches(text: Column, pattern: str, hint: str | None) -> Column:
    """Matches with their places and the words around them, from the pieces that they cut the text into."""
    pieces = F.array(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("t")))
    one = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  so that x is computed once

    def spans(x: Column) -> Column:
        n = F.size(x["t"])
        zipped = F.arrays_zip(x["p"].alias("piece"), x["t"].alias("token"), F.slice(x["p"], 2, n).alias("next"))
        cut = lambda z: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / GATHER).cast("int")), lambda k: F.slice(z, k * GATHER + 1, F.least(F.lit(GATHER), n - k * GATHER)))
        return F.when(n > 0, one(one(zipped, cut), groups)).otherwise(F.array().cast(_SPAN))

    def groups(gathered: Column) -> Column:
        # Lengths of all groups, then of the pieces in a group: a place is a sum of few numbers, however long the text.
        size = lambda y: F.length(y["piece"]).cast("long") + F.length(y["token"])
        lengths = F.transform(gathered, lambda g: F.transform(g, size))
        totals = F.transform(lengths, lambda g: _sum(g, F.size(g)))
        zipped = F.arrays_zip(gathered.alias("own"), lengths.alias("lengths"), F.transform(totals, lambda v, k: one(totals, lambda t: _sum(t, k))).alias("at"))
        return F.flatten(F.transform(zipped, lambda z: F.transform(z["own"], lambda y, i: span(y, z["at"] + _sum(z["lengths"], i)))))

    def span(y: Column, at: Column) -> Column:
        begin = at + F.length(y["piece"])
        return F.struct(begin.alias("start"), (begin + F.length(y["token"])).alias("end"), y["token"].alias("token"), F.substring(y["piece"], -CONTEXT, CONTEXT).alias("before"), F.substring(y["next"], 1, CONTEXT).alias("after"))

    found = F.transform(pieces, spans)[0].cast(_SPAN)
    return F.when(text.contains(hint), found).otherwise(F.array().cast(_SPAN)) if hint else found


def base_spans(docs: DataFrame) -> DataFrame:
    """rid, doc_id, a column of spans for each kind, and candidates: other words with a digit or at sign."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    some = F.col("t").rlike("[0-9@]")
    empty = F.array().cast(_SPAN)
    rows = rows.withColumns({k: F.when(some, F.filter(matches(F.col("t"), p, HINTS[k]), _test(k))).otherwise(empty) for k, p in KINDS.items()})
    rows = rows.withColumn("words", F.when(some, matches(F.col("t"), CANDIDATE, None)).otherwise(empty))
    free = F.col("words")
    for k in KINDS:
        free = F.filter(free, _apart(k))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *KINDS, free.alias("candidates"))


def patterns_of(around: Column) -> Column:
    """The lexical patterns of a place; _ is the place and * any word."""
    l2, l1, r1, r2 = (around[i] for i in range(4))
    some = F.array(*[F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x for x in p)) for p in ((l1, "_"), (l2, l1, "_"), (l2, "*", "_"), ("_", r1), ("_", r1, r2), ("_", "*", r2), (l1, "_", r1))])
    return F.filter(some, lambda p: p.rlike(r"\p{L}"))


def _instances(found: DataFrame) -> DataFrame:
    """rid, kind (null for candidates), start, end, token, patterns."""
    one = lambda c, kind: found.filter(F.size(c) > 0).select("rid", kind.alias("kind"), F.explode(c).alias("s")).select("rid", "kind", "s.*")
    out = one("candidates", F.lit(None).cast("string"))
    for k in KINDS:
        out = out.union(one(k, F.lit(k)))
    around = out.select("rid", "kind", "start", "end", "token", _around(F.col("before"), F.col("after")).alias("around"))
    return around.select("rid", "kind", "start", "end", "token", patterns_of(F.col("around")).alias("patterns"))


def certain_share(part: Column, total: Column) -> Column:
    """The lower end of the 95 % Wilson interval of part / total."""
    z = 1.96
    p = part / total
    return (p + z * z / (2 * total) - z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)) / (1 + z * z / total)


def _either(score: Column) -> Column:
    """Noisy-or of a group's scores."""
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - score, F.lit(1e-9)))))


def learn(seen: DataFrame, generations: int = GENERATIONS, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE, doubt: float = DOUBT) -> DataFrame:
    """Accepted patterns (kind, pattern, score), from the instances of a corpus."""
    graph = settle(seen.select("kind", "token", F.explode("patterns").alias("pattern")).distinct())
    seeds = graph.filter("kind is not null").select("kind", "token", F.lit(1.0).alias("belief")).distinct()
    beliefs, before, scores = settle(seeds), None, None
    for _ in range(generations):
        held = settle(graph.select("token", "pattern").distinct().join(beliefs, "token").groupBy("kind", "pattern").agg(F.sum("belief").alias("mass")))
        strong = held.filter(F.col("mass") >= least_seeds)
        believed = held.join(strong.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(F.sum("mass").alias("all"))
        slots = graph.join(strong.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(F.countDistinct("token").alias("tokens"))
        total = F.col("all") + doubt * F.greatest(F.col("tokens") - F.col("all"), F.lit(0.0))
        score = certain_share(F.col("mass"), total)
        scores = settle(strong.join(believed, "pattern").join(slots, "pattern").select("kind", "pattern", score.alias("score")).filter(F.col("score") >= least_score))
        now = scores.agg(F.count("*"), F.sum(F.xxhash64("kind", "pattern").bitwiseAND(0x7FFFFFFF))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        unseen = graph.filter("kind is null").drop("kind").join(scores, "pattern").groupBy("kind", "token").agg(_either(F.col("score")).alias("belief"))
        beliefs = settle(seeds.unionByName(unseen).groupBy("kind", "token").agg(F.max("belief").alias("belief")))
    return scores


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document."""
    found = settle(base_spans(docs))
    seen = settle(_instances(found))
    marked = seen.filter("kind is null").select("rid", "start", "end", F.explode("patterns").alias("pattern")).join(learn(seen), "pattern")
    # Of the kinds whose patterns claim a place, the one of the largest belief has it.
    claims = marked.groupBy("rid", "start", "end", "kind").agg(_either(F.col("score")).alias("belief")).filter(F.col("belief") >= LEAST_BELIEF)
    added = claims.groupBy("rid", "start", "end").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind")).groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    order = list(KINDS)
    full = found.join(added, "rid", "left")
    spans = lambda k: F.transform(k, lambda s: F.struct(F.lit(order.index(k)).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    base = F.concat(*[spans(k) for k in order])
    new = F.transform(
        F.coalesce("added", F.array().cast("array<struct<kind:string,start:long,end:long>>")),
        lambda s: F.struct((F.array_position(F.array(*map(F.lit, order)), s["kind"]) - 1).cast("int").alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return full.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in order], F.sha2(_join(base), 256).alias("base_sha256"), _join(F.array_sort(F.concat(base, new))).alias("spans"))
