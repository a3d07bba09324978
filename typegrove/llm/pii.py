"""Personal data by weak supervision (DataFrame functions only).

Candidates are the base patterns' valid matches and looser ones that the base misses: addresses with the at sign, a dot or
both written out, phone numbers in national groups of 9 to 15 digits, cards of 13 to 19 digits with other separators, IPs
with guarded dots. Labelers vote on every candidate: a check of its digits or domain (Luhn, octets, group lengths), a
gazetteer (top-level domains, issuers' first digits, and the like), cue words before it, its borders, and numbers around
it; each says yes, no or nothing, and each can say both yes and no of base and of loose candidates. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is per kind and how likely each pattern is personal data. These probabilities train the final span
classifier, a naive Bayes model over features of the span and its neighbourhood in a fixed number of slots. Base spans
stay; others are added if the classifier says so.

The vote patterns (at most 3 ** 5 per kind) and feature slots are all that reaches the driver. Matches come from two
linear passes (split and extract by one pattern that never rescans a run of characters); positions are running sums of
lengths, in code points, and overlaps running maxima, both taken block by block, so that the time grows with the number
of matches and not with its square.

Defined results: a null text is empty; rows are handled one by one, so repeated rows give equal results; without any
loose candidate the result is the base; a very long text has its spans in one row; other columns are not looked at; no
rows give no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("check", "gazetteer", "context", "border", "numbers")
NEAR = 24
#: Feature slots of each kind.
SLOTS = 256

# The base patterns. A match may begin only where a run of its first class begins, or where the last match ended, and
# takes runs whole: the same matches as without, and no run is scanned twice.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?", r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?"
LOOSE = {
    # at written out and dots in either form, or a plain at sign and a dot written out
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:{AT}[A-Za-z0-9-]{{1,63}}+(?:(?:{DOT}|\.)[A-Za-z0-9-]{{1,63}}+)++|@[A-Za-z0-9-]{{1,63}}+(?:\.[A-Za-z0-9-]{{1,63}}+)*+(?:{DOT}[A-Za-z0-9-]{{1,63}}+)++)",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[./_\x20-][0-9]{3,7}+){2,5}+(?![0-9])",
    "phone": r"(?<![0-9+().-])(?:00[1-9][0-9]{0,2}+[\x20./-]?)?+(?:\([0-9]{1,5}\)[\x20./-]?|[0-9]{2,5}+[\x20./-])(?:[0-9]{2,8}+[\x20./-](?=[0-9])){0,5}+[0-9]{2,8}+(?![0-9])",
}
#: Digits that a loose candidate must have.
LEAST_MOST = {"card": (13, 19), "phone": (9, 15)}
#: What a text must hold for the pattern to be tried at all.
HINTS = {"email": "@", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
VALID_IP = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
DOMAINS = r"(?i)(?:com|org|net|edu|gov|mil|int|info|biz|io|de|fr|es|uk|it|nl|eu|us|ca|au|jp|cn|in|br|ch|at|be|se|mx)$"
CUES = {
    "email": r"(?i)e-?mail|contact|correo|courriel|write|reach|kontakt",
    "ip": r"(?i)\bip\b|host|server|address|adresse|from|client",
    "card": r"(?i)card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|\btel|call|mobile|fax|cell|telefon|tel[eé]fono",
}
NOT_CUES = r"(?i)version|\bv\.?$|order|isbn|issn|invoice|\bref|\bno\.?\s*$|§|section|chapter"
SPAN = "array<struct<kind:int,start:int,end:int,hit:string,left:string,right:string,base:boolean>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def valid(kind: str, hit: Column) -> Column:
    """The base rules that a pattern alone can't state."""
    if kind == "ip":
        return hit.rlike(VALID_IP)
    if kind == "card":
        return common.let(digits(hit), lambda d: F.char_length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.char_length(digits(hit)).between(9, 15)
    return F.lit(True)


def _is_valid(kind: str):
    return lambda s: valid(kind, s["hit"])


def running(values: Column, op, start: Column, block: int = 64, levels: int = 3) -> Column:
    """For each value of an array the ``op`` of ``start`` and all before it.

    Blocks are reduced first, then run through on their own, each from what comes before it; so appending to an array,
    which copies it, only meets short ones. ``levels`` of blocks keep that so up to some 10 ** 7 values.
    """

    def plain(all_: Column, first: Column) -> Column:
        def step(s, x):
            return F.struct(op(s["at"], x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))

        empty = F.slice(F.array(first), 1, 0)
        return F.aggregate(all_, F.struct(first.alias("at"), empty.alias("out")), step, lambda s: s["out"])

    if not levels:
        return plain(values, start)

    def blocks(all_: Column) -> Column:
        def own(b):
            return F.slice(all_, b * block + 1, block)

        numbers = F.sequence(F.lit(0), F.floor((F.array_size(all_) - 1) / block).cast("int"))
        reduced = F.transform(numbers, lambda b: F.aggregate(own(b), start, op))
        return common.let(running(reduced, op, start, block, levels - 1), lambda p: F.flatten(F.transform(p, lambda x, b: plain(own(b), x))))

    return F.when(F.array_size(values) <= block, plain(values, start)).otherwise(common.let(values, blocks))


def matches(text: Column, pattern: str, kind: int, base: bool) -> Column:
    """Matches with positions (code points, end exclusive) and up to NEAR characters on either side."""

    def placed(hits, gaps):
        steps = F.transform(hits, lambda h, i: F.char_length(F.get(gaps, i)) + F.char_length(h))

        def span(at, i):
            gap, hit = F.get(gaps, i), F.get(hits, i)
            start = at + F.char_length(gap)
            end = start + F.char_length(hit)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), hit.alias("hit"), F.right(gap, F.lit(NEAR)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(NEAR)).alias("right"), F.lit(base).alias("base"))

        return F.transform(running(steps, lambda a, x: a + x, F.lit(0)), span)

    def found(hits):
        return F.when(F.array_size(hits) == 0, F.array().cast(SPAN)).otherwise(common.let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps)))

    return common.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def candidates(text: Column) -> Column:
    """Valid base spans and the loose ones that overlap none of their kind, by kind and start."""
    parts = []
    digit = text.rlike("[0-9]")
    for k, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else digit
        base = F.filter(matches(text, BASE[kind], k, True), _is_valid(kind))
        parts.append(F.when(hint, base).otherwise(F.array().cast(SPAN)))
        hint = text.rlike(r"(?i)[\x20(\[{](?:at|dot)[\x20)\]}]") if kind == "email" else digit
        loose = matches(text, LOOSE[kind], k, False)
        if kind in LEAST_MOST:
            loose = F.filter(loose, _long_enough(kind))
        parts.append(F.when(hint, loose).otherwise(F.array().cast(SPAN)))
    return F.array_sort(_without_overlaps(F.concat(*parts)))


def _long_enough(kind: str):
    least, most = LEAST_MOST[kind]
    return lambda s: F.char_length(digits(s["hit"])).between(least, most)


def _without_overlaps(spans: Column) -> Column:
    """Base spans, and the loose ones that none of their kind overlaps.

    In order of kind and start, a loose span is met by a base one before it if the greatest end of those lies behind its
    start, and by one after it if the least start of those lies before its end. Kinds are kept apart by a distance that no text has.
    """
    far = F.lit(1 << 40)

    def free(s):
        ends = F.transform(s, lambda x: F.when(x["base"], x["kind"] * far + x["end"]).otherwise(F.lit(-1)))
        starts = F.transform(F.reverse(s), lambda x: F.when(x["base"], x["kind"] * far + x["start"]).otherwise(far * 9))
        before = running(ends, lambda a, x: F.greatest(a, x), F.lit(-1).cast("long"))
        after = running(starts, lambda a, x: F.least(a, x), far * 9)

        def kept(b, a):
            return F.filter(s, lambda x, i: x["base"] | ((F.get(b, i) <= x["kind"] * far + x["start"]) & (F.get(a, F.array_size(s) - 1 - i) >= x["kind"] * far + x["end"])))

        return common.let(before, lambda b: common.let(after, lambda a: kept(b, a)))

    # most texts have no loose candidate, and nothing to compare
    return common.let(spans, lambda a: F.when(F.exists(a, lambda s: ~s["base"]), common.let(F.array_sort(a), free)).otherwise(a))


def votes(s: Column) -> Column:
    """array<int> of 1, -1 or 0 (no vote), in the order of LABELERS."""
    kind, hit, left, right = s["kind"], s["hit"], s["left"], s["right"]
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    d = F.char_length(digits(hit))
    groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
    check = (
        # an at sign or bracketed words, not words alone
        F.when(kind == 0, F.when(F.regexp_replace(hit, "(?i)" + DOT, ".").rlike(r"(?i)[@)\]}].*\.[a-z]{2,24}$"), yes).otherwise(no))
        .when(kind == 1, F.when(F.forall(groups, lambda g: g.rlike("^" + OCTET + "$")) & ~F.contains(hit, F.lit(" ")), yes).otherwise(no))
        .when(kind == 2, F.when(F.call_function("luhn_check", digits(hit)), yes).otherwise(no))
        # a trunk or country prefix, or groups as countries without one write them
        .otherwise(F.when(hit.rlike(r"^(?:\+|00?[1-9]|\()|^[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), yes).otherwise(no))
    )
    gazetteer = (
        F.when(kind == 0, F.when(hit.rlike(DOMAINS), yes).otherwise(no))
        .when(kind == 1, F.when(hit.rlike(r"^(?:0|255)|^([0-9]+)\W+\1\W+\1\W+\1$"), no).otherwise(yes))
        .when(kind == 2, F.when(digits(hit).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), yes).otherwise(no))
        .otherwise(F.when(d.between(10, 13), yes).otherwise(no))
    )
    cue = F.lit(None).cast("boolean")
    for k, name in enumerate(KINDS):
        cue = F.when(kind == k, left.rlike(CUES[name])).otherwise(cue)
    context = F.when(left.rlike(NOT_CUES), no).when(cue, yes).otherwise(none)
    border = F.when(left.rlike(r"[\p{L}\p{N}_]$") | right.rlike(r"^[\p{L}\p{N}_@]"), no).otherwise(yes)
    numbers = F.when(left.rlike(r"[0-9][^\p{L}]*$") | right.rlike(r"^[^\p{L}]*[0-9]"), no).otherwise(none)
    return F.array(check, gazetteer, context, border, numbers)


def features(s: Column) -> Column:
    """array<int>: slots of the span's features, the kind in each."""
    shape = F.regexp_replace(F.regexp_replace(s["hit"], "[0-9]", "9"), r"[\p{L}]+", "a")
    parts = {
        "votes": F.array_join(F.transform(votes(s), lambda v: v.cast("string")), " "),
        "shape": shape,
        "length": F.char_length(s["hit"]).cast("string"),
        "before": F.lower(F.regexp_extract(s["left"], r"([\p{L}]+)[^\p{L}]*$", 1)),
        "left": F.regexp_replace(F.right(s["left"], F.lit(1)), r"[\p{L}]", "a"),
        "right": F.regexp_replace(F.left(s["right"], F.lit(1)), r"[\p{L}]", "a"),
    }
    return F.array(*[(s["kind"] * SLOTS + F.pmod(F.xxhash64(F.lit(name), value), F.lit(SLOTS))).cast("int") for name, value in parts.items()])


def estimate(patterns: list, rounds: int = 40) -> dict[tuple[int, tuple[int, ...]], float]:
    """Probability of each (kind, votes) by expectation-maximisation. patterns: (kind, votes, n), a bounded number.

    Every labeler has, per kind, a rate of yes among its votes on true and on false candidates; abstaining says nothing.
    """
    out = {}
    for kind in range(len(KINDS)):
        own = [(tuple(v), n) for k, v, n in patterns if k == kind]
        if not own:
            continue
        prior = 0.7
        yes = [(0.8, 0.35) for _ in LABELERS]

        def posterior(v, prior, yes):
            t, f = math.log(prior), math.log(1 - prior)
            for vote, (a, b) in zip(v, yes):
                if vote:
                    t += math.log(a if vote > 0 else 1 - a)
                    f += math.log(b if vote > 0 else 1 - b)
            return 1 / (1 + math.exp(min(700.0, f - t)))

        for _ in range(rounds):
            p = [posterior(v, prior, yes) for v, _ in own]
            total = sum(n for _, n in own)
            prior = min(0.98, max(0.02, (sum(x * n for x, (_, n) in zip(p, own)) + 7) / (total + 10)))
            fresh = []
            for l in range(len(LABELERS)):
                rate = []
                for truth, (a, b) in ((True, (8, 2)), (False, (2, 8))):  # a prior of ten votes: labelers beat chance
                    w = [(x if truth else 1 - x) * n for x, (_, n) in zip(p, own)]
                    on = sum(c for c, (v, _) in zip(w, own) if v[l] > 0)
                    voted = sum(c for c, (v, _) in zip(w, own) if v[l])
                    rate.append(min(0.99, max(0.01, (on + a) / (voted + a + b))))
                fresh.append(tuple(rate))
            yes = fresh
        out.update({(kind, v): posterior(v, prior, yes) for v, _ in own})
    return out


def train(spans: DataFrame, scratch: common.Scratch) -> tuple[list[float], list[float]]:
    """Log-odds of every feature slot, and of every kind. spans: column ``spans`` of candidates."""
    one = spans.select(F.explode("spans").alias("s")).select(F.col("s.kind").alias("kind"), votes(F.col("s")).alias("votes"), features(F.col("s")).alias("features"))
    counts = scratch.keep(one.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "patterns")
    rows = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()  # at most 4 * 3 ** 5
    likely = estimate([(r["kind"], r["votes"], r["n"]) for r in rows])
    p = F.lit(0.0)
    for (kind, v), x in likely.items():
        p = F.when((F.col("kind") == kind) & (F.col("votes") == F.array(*map(F.lit, v))), F.lit(x)).otherwise(p)
    soft = counts.withColumn("p", p)
    true, false = F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))
    total = {r["kind"]: (r["t"] + 1, r["f"] + 1) for r in soft.groupBy("kind").agg(true.alias("t"), false.alias("f")).collect()}  # a row a kind
    slots = soft.select(F.explode("features").alias("slot"), "kind", "n", "p").groupBy("slot", "kind").agg(true.alias("t"), false.alias("f")).collect()  # SLOTS rows a kind
    weights = [0.0] * (SLOTS * len(KINDS))
    for r in slots:
        yes, no = total[r["kind"]]
        weights[r["slot"]] = math.log((r["t"] + 1) / (yes + 2)) - math.log((r["f"] + 1) / (no + 2))
    return weights, [math.log(t / f) for t, f in (total.get(k, (1, 1)) for k in range(len(KINDS)))]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: array of kind, start, end, base, score, by kind and start; base spans and accepted ones."""
    scratch = common.Scratch(docs.sparkSession, "pii")
    rows = docs.select("doc_id", common.text_of().alias("text")).select("doc_id", candidates(F.col("text")).alias("spans"))
    rows = scratch.keep(rows, "candidates")
    weights, kinds = (F.from_json(F.lit(json.dumps(x)), "array<double>") for x in train(rows, scratch))

    def scored(s):
        odds = F.aggregate(features(s), F.get(kinds, s["kind"]), lambda a, i: a + F.get(weights, i))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), (1 / (1 + F.exp(-odds))).alias("score"))

    spans = F.filter(F.transform("spans", scored), lambda s: s["base"] | (s["score"] >= 0.5))
    return rows.select("doc_id", F.when(F.array_size("spans") == 0, F.lit(None)).otherwise(spans).alias("spans")).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,score:double>>")))


def _equals(k: int):
    return lambda x: x == k


def named(spans: Column) -> Column:
    kind = F.lit(None).cast("string")

    def of(s):
        name = kind
        for k, x in enumerate(KINDS):
            name = F.when(s["kind"] == k, F.lit(x)).otherwise(name)
        return F.concat_ws(":", name, s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, of), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.array_size(F.filter(F.transform(base, lambda s: s["kind"]), _equals(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), F.array_size("spans").cast("long").alias("n_spans"))
