"""Personal data by weak supervision.

Base spans come from four fixed patterns and their checks. Beyond them, looser
patterns give candidates (addresses spelled with "(at)", phone numbers without
a plus sign, card numbers in other groupings, IPv6). Five labelers vote on every
candidate (1, -1 or 0 for none): the base pattern, a gazetteer, cue words before
the span (in the text since the pattern's last match), the characters at its
borders, and a checksum or range check.
Expectation-maximisation over the counts of vote patterns of the whole corpus
estimates how reliable each labeler is; its posteriors are the training target
of a logistic span classifier over the votes. A candidate it accepts with at
least ``ACCEPT`` is added, unless it overlaps a base span; base spans all stay.

The plan is DataFrame functions only and every span is found inside its own row:
no text is shuffled. Only vote patterns are aggregated (``4 * 2 * 3**5`` rows at
most, however large the corpus), and fitting sees those on the driver.

Patterns are written so that no input is slow: possessive repeats, and a run of
characters is entered at its start or where the last match ended only, which
finds the same leftmost matches. Places are running sums over blocks of matches,
context comes from the gaps between matches, and overlaps are found by bisection
or a running maximum, so work grows with a text's length, not with its square.

Edge cases: a null text is the empty text: no spans; repeated rows and null ids
keep their rows; an empty table gives an empty result and a model that adds
nothing; of spans that start alike the kind listed first comes first; :func:`find`
replaces a column named as its result, :func:`redact` keeps all other columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
ACCEPT = 0.9
CONTEXT = 40
ROUNDS = 60
LABELERS = ["pattern", "gazetteer", "context", "border", "check"]

#: Base patterns; each equals the plain form in its comment, match for match.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no base match that could pass.
GUARD = {"email": "@[A-Za-z0-9-]+[.]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]{0,63}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![0-9._/])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
LOOSE_GUARD = {"email": r"[\[(]at[\])]", "ip": "(?:[0-9A-Fa-f]{1,4}:){7}", "card": "[0-9]{4}[._/][0-9]{4}[._/]", "phone": r"[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}"}
#: Gazetteer: endings of addresses, ranges of issuers and codes of countries.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|eu|us|ca|example|test)$",
    "ip": r"^(?!0|127\.|22[4-9]|23[0-9]|24[0-9]|25[0-5])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])[^0-9]|^[(2-9]",
}
CUES = {
    "email": r"(?i)mail|contact|kontakt|correo|courriel|write",
    "ip": r"(?i)\bip\b|host|server|address|adresse|direcci",
    "card": r"(?i)card|karte|carte|tarjeta|visa|credit|pay",
    "phone": r"(?i)phone|tel|call|mobile|fax|anruf|appel|llam",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PARTS = rf"^{PART}(?:\.{PART}){{3}}$"

SPAN = "array<struct<s:int,e:int,v:string,before:string,sides:string>>"
#: Elements that are summed one by one; sums of so many are summed again.
RUN = 256
#: Characters of the pieces that a text is cut into before parts of it are taken.
PIECE = 1024


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, zero: Column, op) -> Column:
    """What ``op`` makes of all values before each one, then of all, one element more than there are values."""
    def plain(xs: Column) -> Column:
        return F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def blocked(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda b: F.slice(xs, b * RUN + 1, RUN))
        bases = lambda bs: plain(F.transform(bs, lambda b: F.aggregate(b, zero, op)))
        # Each block's own sums but the last, then the total.
        local = lambda b: F.slice(plain(b), 1, F.size(b))
        joined = lambda bs, ts: F.concat(F.flatten(F.transform(bs, lambda b, i: F.transform(local(b), lambda x: op(F.get(ts, i), x)))), F.array(F.element_at(ts, -1)))
        return _let(blocks, lambda bs: _let(bases(bs), lambda ts: joined(bs, ts)))

    return F.when(F.size(values) <= RUN, plain(values)).otherwise(blocked(values))


def matches(text: Column, pattern: str, guard: str) -> Column:
    """Leftmost non-overlapping matches with their place in code points (end exclusive), the text before each and the characters at its sides."""
    def placed(gaps: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))

        def span(starts: Column):
            def at(v: Column, i: Column) -> Column:
                gap, rest = F.get(gaps, i), F.get(gaps, i + 1)
                first = F.when(gap != "", F.substring(gap, -1, 1)).when(i > 0, F.substring(F.get(found, i - 1), -1, 1)).otherwise(F.lit(" "))
                last = F.when(rest != "", F.substring(rest, 1, 1)).otherwise(F.coalesce(F.substring(F.get(found, i + 1), 1, 1), F.lit("")))
                s = F.get(starts, i) + F.length(gap)
                return F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v"), F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.concat(first, last).alias("sides"))

            return F.transform(found, at)

        return _let(_running(lengths, F.lit(0), lambda a, x: a + x), span)

    split = lambda gaps: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: placed(gaps, found))
    return F.when(text.rlike(guard), _let(F.split(text, pattern, -1), split)).otherwise(F.array().cast(SPAN))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _card_ok(v: Column) -> Column:
    return _let(_digits(v), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))


def _check(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(PARTS) | v.contains(":")
    if kind == "card":
        return _card_ok(v)
    if kind == "phone":
        return F.length(_digits(v)).between(10, 15)
    return F.lit(True)


def candidates(text: Column) -> Column:
    """All base matches and loose candidates of a text with their votes, by kind.

    ``base`` marks the spans of the contract. Base matches that fail their check
    stay as candidates: they show the labelers' errors.
    """
    parts = []
    for k, kind in enumerate(KINDS):
        for loose in (False, True):
            spans = matches(text, LOOSE[kind] if loose else BASE[kind], LOOSE_GUARD[kind] if loose else GUARD[kind])
            if kind == "card" and not loose:
                spans = F.filter(spans, lambda x: F.length(_digits(x["v"])) >= 13)

            parts.append(F.transform(spans, _voter(k, loose)))
    return F.concat(*parts)


def _voter(k: int, loose: bool):
    kind = KINDS[k]
    sign = lambda c: F.when(c, 1).otherwise(-1)

    def voted(x: Column) -> Column:
        ok = _check(kind, x["v"])
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"), (F.lit(not loose) & ok).alias("base"), F.lit(loose).alias("loose"),
            (F.lit(0) if loose else F.lit(1)).alias("pattern"),
            sign(x["v"].rlike(GAZETTEER[kind])).alias("gazetteer"),
            F.when(x["before"].rlike(CUES[kind]), 1).otherwise(0).alias("context"),
            sign(~x["sides"].rlike(r"[\p{L}\p{N}]")).alias("border"),
            sign(ok).alias("check"),
        )

    return voted


def fit(df: DataFrame, text_col: str = "text") -> dict:
    """Reliability of each labeler and the weights of the span classifier."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    votes = df.select(F.explode(candidates(text)).alias("c")).select("c.k", "c.loose", *(f"c.{x}" for x in LABELERS))
    counted = votes.groupBy("k", "loose", *LABELERS).count().collect()  # a bounded number of vote patterns
    rows = sorted((tuple(int(r[x]) for x in LABELERS), r.k, bool(r.loose), r["count"]) for r in counted)
    reliability, prior = expectation_maximisation([(v, n) for v, _, _, n in rows])
    target = [_posterior(v, reliability, prior) for v, _, _, _ in rows]
    return {"reliability": reliability, "prior": prior, "weights": _logistic([(_features(v, k, loose), t, n) for (v, k, loose, n), t in zip(rows, target, strict=True)])}


def _posterior(votes: tuple[int, ...], reliability, prior: float) -> float:
    score = math.log(prior / (1 - prior)) + sum(math.log(reliability[i][1][v] / reliability[i][0][v]) for i, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, score))))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS):
    """For each labeler and class the chance of each vote, and the share of true spans.

    Starts from the majority of votes; counts are smoothed in favour of labelers
    that are right more often than not.
    """
    lean = {1: {1: 4.0, 0: 1.0, -1: 1.0}, 0: {1: 1.0, 0: 1.0, -1: 4.0}}
    belief = [0.9 if sum(v) > 1 else 0.1 for v, _ in patterns]
    prior, reliability = 0.5, []
    for _ in range(rounds):
        mass = {1: sum(b * n for b, (_, n) in zip(belief, patterns, strict=True)), 0: sum((1 - b) * n for b, (_, n) in zip(belief, patterns, strict=True))}
        prior = (mass[1] + 1) / (mass[1] + mass[0] + 2)
        reliability = []
        for i in range(len(LABELERS)):
            table = {y: dict(lean[y]) for y in (0, 1)}
            for b, (v, n) in zip(belief, patterns, strict=True):
                table[1][v[i]] += b * n
                table[0][v[i]] += (1 - b) * n
            reliability.append({y: {vote: x / sum(table[y].values()) for vote, x in table[y].items()} for y in (0, 1)})
        belief = [_posterior(v, reliability, prior) for v, _ in patterns]
    return reliability, prior


def _features(votes, k: int, loose: bool) -> list[float]:
    return [1.0, *(float(v == 1) for v in votes), *(float(v == -1) for v in votes), *(float(k == j) for j in range(len(KINDS))), float(loose)]


def _logistic(rows: list[tuple[list[float], float, int]], steps: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    width = 2 + 2 * len(LABELERS) + len(KINDS)
    w = [0.0] * width
    total = sum(n for _, _, n in rows)
    if not total:
        return [-10.0] + w[1:]
    # Rare patterns count too: weights grow with the logarithm of their number.
    weight = [math.log1p(n) for _, _, n in rows]
    scale = sum(weight)
    for _ in range(steps):
        grad = [ridge * x for x in w]
        for (x, t, _), m in zip(rows, weight, strict=True):
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for j, b in enumerate(x):
                if b:
                    grad[j] += m / scale * (p - t) * b
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def spans(text: Column, model: dict) -> Column:
    """Base and accepted spans ``(s, e, k, base)`` of a text, by start, then kind."""
    w, m = model["weights"], len(LABELERS)
    limit = math.log(ACCEPT / (1 - ACCEPT))

    def score(c: Column) -> Column:
        total = F.lit(w[0])
        for i, name in enumerate(LABELERS):
            total = total + F.when(c[name] == 1, w[1 + i]).when(c[name] == -1, w[1 + m + i]).otherwise(0.0)
        return total + F.element_at(F.array(*(F.lit(x) for x in w[1 + 2 * m : 1 + 2 * m + len(KINDS)])), c["k"] + 1) + F.when(c["loose"], w[-1]).otherwise(0.0)

    def reaches(base: Column, c: Column) -> Column:
        """True if a span of ``base``, in order and without overlaps, shares a character with ``c``: the last that starts before its end does."""
        def halve(state: Column, _: Column) -> Column:
            middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
            left = F.get(base, middle)["s"] < c["e"]
            wide = state["lo"] < state["hi"]
            return F.struct(F.when(wide & left, middle + 1).otherwise(state["lo"]).alias("lo"), F.when(wide & ~left, middle).otherwise(state["hi"]).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.size(base).alias("hi"))
        steps = F.length(F.bin(F.size(base).cast("long")))  # of n + 1 places each step leaves half
        return F.aggregate(F.sequence(F.lit(1), steps), start, halve, lambda state: F.coalesce(F.get(base, state["lo"] - 1)["e"] > c["s"], F.lit(False)))

    def chosen(found: Column) -> Column:
        base = F.filter(found, lambda c: c["base"])
        added = F.filter(found, lambda c: ~c["base"] & c["loose"] & (score(c) >= limit))

        def both(base: Column, added: Column) -> Column:
            of = lambda k: F.filter(base, lambda b: b["k"] == k)
            by_kind = F.array(*(of(k) for k in range(len(KINDS))))
            free = _let(by_kind, lambda kinds: F.filter(added, lambda c: ~F.exists(kinds, lambda bs: reaches(bs, c))))
            spans = F.concat(base, F.when(F.size(added) > 0, free).otherwise(added))
            return F.sort_array(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["base"].alias("base"))))

        return _let(base, lambda b: _let(added, lambda a: both(b, a)))

    return _let(candidates(text), chosen)


def find(df: DataFrame, model: dict, text_col: str = "text", out: str = "spans") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumn(out, spans(text, model))


def redact(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by its kind in brackets, and ``n_chars``, if present, renewed. A null text stays null."""
    text = F.col("__text")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """Characters ``start`` to ``end`` (exclusive) of a text given in pieces."""
        first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        part = lambda i: F.substring(F.get(pieces, i), F.greatest(start - i * PIECE, F.lit(0)) + 1, end - F.greatest(start, i * PIECE))
        return F.when(start < end, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise(F.lit(""))

    def rebuilt(pieces: Column, done: Column) -> Column:
        """Before each span that starts where the ones before it have ended: the text since then, and the kind's name."""
        kept = F.transform("__spans", lambda x, i: F.when(x["s"] >= F.get(done, i), F.concat(cut(pieces, F.get(done, i), x["s"]), F.get(names, x["k"]))))
        return F.concat(F.array_join(kept, ""), cut(pieces, F.element_at(done, -1), F.length(text)))

    done = _running(F.transform("__spans", lambda x: x["e"]), F.lit(0), lambda a, x: F.greatest(a, x))
    clean = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: _let(done, lambda d: rebuilt(pieces, d)))
    columns = df.columns
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = find(rows, model, "__text", "__spans").withColumn("__clean", F.when(F.size("__spans") > 0, clean).otherwise(text))
    kept = {text_col: F.when(F.col(f"__row.`{text_col}`").isNotNull(), F.col("__clean"))}
    if "n_chars" in columns:
        kind = dict(df.dtypes)["n_chars"]
        kept["n_chars"] = F.when(F.size("__spans") > 0, F.length("__clean").cast(kind)).otherwise(F.col("__row.n_chars"))
    return rows.select(*(kept.get(c, F.col(f"__row.`{c}`")).alias(c) for c in columns))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, fit(docs)).select("doc_id", "spans")
    kinds = F.array(*(F.lit(k) for k in KINDS))
    base = F.filter("spans", lambda c: c["base"])
    line = lambda xs: F.array_join(F.transform(xs, lambda c: F.concat_ws(":", F.element_at(kinds, c["k"] + 1), c["s"], c["e"])), ",")
    count = lambda j: F.size(F.filter(base, lambda c: c["k"] == j)).cast("long")
    return found.select("doc_id", *(count(j).alias(f"n_{k}") for j, k in enumerate(KINDS)), F.sha2(F.encode(line(base), "UTF-8"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
