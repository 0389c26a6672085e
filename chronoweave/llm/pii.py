"""Personal data by weak supervision, with DataFrame functions only.

Base spans follow four fixed patterns and checks.  The method proposes further spans (numbers that the
base patterns run together, spelled-out addresses, keyed secrets) in what the base spans of their kind
leave of a text; labelers vote on every span: the format's check, a gazetteer, the words before it, its
boundaries and the variety of its characters.  Votes meet in a table of patterns (kind, five votes of
three values and three span features of a few values, so its size is bounded); on that table
expectation-maximisation estimates each labeler's reliability by kind and the posterior of each vote, and
a logistic span classifier is trained on them with the span's own features: its length, its first
character and what stands before it.  Proposals that it accepts are added; base spans always stay.

Work is linear in a text: offsets are summed in blocks of matches, and contexts come from the pieces
between matches, never by counting from the text's start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Stage, plain_docs

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Base patterns, written so that a scan is linear: runs are entered at their start (or where the last
#: match ended) and never given back.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the method proposes beyond the base patterns.
MORE = {
    "email": rf"(?<![{_LOCAL}])[A-Za-z][{_LOCAL}]{{1,63}}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{{2,24}}){{1,4}}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "secret": r"(?i)(?<=(?:token|secret|api_key|password)\x20?[=:]\x20?\"?)[A-Za-z0-9_+/-]{16,256}",
}
#: Cheap conditions without which a pattern cannot match.
NEEDS = {
    "email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]",
    "secret": r"(?i)(?:token|secret|api_key|password)\x20?[=:]",
}
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|10\.|127\.|255\.|192\.168\.)",
    "card": r"^[3-6]",
    "phone": r"^\+(?:1|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])[^0-9]",
    "secret": r"^(?:[0-9a-fA-F]{32,}|AKIA|ghp_|sk-)",
}
CONTEXT_FOR = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|payment|server|host|address|token|key|secret|password)[^A-Za-z]{0,8}$"
CONTEXT_AGAINST = r"(?i)(?:version|release|page|isbn|issn|order|chapter|section|figure|table)[^A-Za-z]{0,8}$"
_SPANS = "array<struct<kind:string,s:int,e:int,m:string,b:string,a:string>>"
BLOCK = 256  # matches whose offsets are summed together
GONE = "\u0001"  # stands for each character of a base span; no pattern matches it


def _found(text: str, kind: str, pattern: str, need: str) -> Column:
    """All matches with code-point offsets and neighbours: the pieces between them give where each begins."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(
        F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("p"), matches.alias("m"), F.slice(pieces, 2, F.size(matches)).alias("q")),
        lambda x: F.struct(F.length(x["p"]).alias("g"), F.length(x["m"]).alias("n"), x["m"].alias("m"), F.right(x["p"], F.lit(24)).alias("b"), F.left(x["q"], F.lit(1)).alias("a")))
    none = F.array().cast(_SPANS)

    def step(acc, x):
        s = acc["at"] + x["g"]
        span = F.struct(F.lit(kind).alias("kind"), s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"))
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def block(acc, part):
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
    found = F.when(F.size(matches) > 0, F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["out"]))).otherwise(none)
    return F.when(F.regexp_like(text, F.lit(need)), found).otherwise(none)


def _blanked(text: str, kind: str, pattern: str, need: str) -> Column:
    """The text with its base spans of a kind covered, character by character."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(_valid(kind, m), F.repeat(F.lit(GONE), F.length(m))).otherwise(m))
    pieces = F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return F.when(F.regexp_like(text, F.lit(need)), F.array_join(pieces, "")).otherwise(F.col(text))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    twice = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.try_to_number(d, F.lit("9")).cast("int") * (1 + i % 2))
    return F.aggregate(twice, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The base checks."""
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))
    d = _digits(m)
    if kind == "card":
        return F.length(d).between(16, 19) & _luhn(d)
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(True)


def _checks(kind: str):
    return lambda x: _valid(kind, x["m"])


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _by_kind(kind: Column, f) -> Column:
    out = F.lit(False)
    for k in KINDS:
        out = F.when(kind == k, f(k)).otherwise(out)
    return out


def _votes(x: Column) -> Column:
    """``kind:votes:features`` of one span; a vote is + for, - against, 0 none."""
    kind, m, before = x["kind"], x["m"], x["b"]
    sign = lambda yes, no: F.when(yes, "+").when(no, "-").otherwise("0")
    checked = _by_kind(kind, lambda k: _valid(k, m) if k in BASE else F.regexp_like(m, F.lit("[0-9]")))
    listed = _by_kind(kind, lambda k: F.regexp_like(m, F.lit(GAZETTEER[k])))
    variety = F.size(F.array_distinct(F.split(m, ""))) >= 5
    edge = ~F.regexp_like(x["a"], F.lit("^[A-Za-z0-9]"))
    votes = [sign(checked, ~checked), sign(listed, F.lit(False)), sign(F.regexp_like(before, F.lit(CONTEXT_FOR)), F.regexp_like(before, F.lit(CONTEXT_AGAINST))), sign(edge, ~edge), sign(variety, ~variety)]
    length = F.least(F.floor(F.length(m) / 8), F.lit(4)).cast("string")
    first = F.when(F.regexp_like(m, F.lit("^[0-9]")), "d").when(F.regexp_like(m, F.lit("^[A-Za-z]")), "a").otherwise("o")
    lead = F.when(F.regexp_like(before, F.lit("[:=]\\s?\"?$")), "c").when(F.regexp_like(before, F.lit("(?:^|\\s)$")), "s").otherwise("o")
    return F.concat(kind, F.lit(":"), *votes, F.lit(":"), length, first, lead)


def reliabilities(patterns: dict[str, int], rounds: int = 40) -> dict[str, float]:
    """Posterior of each pattern by expectation-maximisation over its votes, independent labelers by kind."""
    out = {}
    for kind in KINDS:
        own = {}
        for p, n in patterns.items():
            if p.startswith(kind + ":"):
                own[p.split(":")[1]] = own.get(p.split(":")[1], 0) + n
        post = {v: 0.9 if v.count("+") > v.count("-") else 0.1 for v in own}
        for _ in range(rounds if own else 0):
            total = sum(own.values())
            prior = (1 + sum(n * post[v] for v, n in own.items())) / (2 + total)
            rate = []  # by labeler and class, the smoothed share of each vote
            for j in range(5):
                share = []
                for side in (0, 1):
                    w = {c: (4.0 if c == ("+" if side else "-") else 1.0) for c in "+-0"}  # a labeler is taken to be better than chance
                    for v, n in own.items():
                        w[v[j]] += n * (post[v] if side else 1 - post[v])
                    s = sum(w.values())
                    share.append({c: x / s for c, x in w.items()})
                rate.append(share)
            for v in own:
                yes = math.log(prior) + sum(math.log(rate[j][1][v[j]]) for j in range(5))
                no = math.log(1 - prior) + sum(math.log(rate[j][0][v[j]]) for j in range(5))
                post[v] = 1 / (1 + math.exp(max(-60, min(60, no - yes))))
        out |= {p: post[p.split(":")[1]] for p in patterns if p.startswith(kind + ":")}
    return out


def _features(pattern: str) -> list[str]:
    """A span's votes, its kind, and its length, first character and lead, each by kind."""
    kind, votes, shape = pattern.split(":")
    return [f"{j}{c}" for j, c in enumerate(votes)] + [kind, kind + votes[0]] + [f"{kind}/{j}{c}" for j, c in enumerate(shape)]


def classifier(patterns: dict[str, int], posterior: dict[str, float], rounds: int = 200, rate: float = 0.5) -> dict[str, float]:
    """Span scores of the patterns from a logistic model on votes and span features, fit to the posteriors."""
    total = sum(patterns.values()) or 1
    feats = {p: _features(p) for p in patterns}
    weight = {f: 0.0 for x in feats.values() for f in x}
    score = lambda p: 1 / (1 + math.exp(-max(-30, min(30, sum(weight[f] for f in feats[p])))))
    for _ in range(rounds):
        slope = dict.fromkeys(weight, 0.0)
        for p, n in patterns.items():
            g = (score(p) - posterior[p]) * (math.sqrt(n) / math.sqrt(total))
            for f in feats[p]:
                slope[f] += g
        for f, g in slope.items():
            weight[f] -= rate * (g + 1e-4 * weight[f])
    return {p: score(p) for p in patterns}


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added``: spans (kind, s, e), code points, end exclusive, by kind and start.

    Null and empty texts have none.  Each row is taken by itself, repeated ones too; other columns are
    ignored; an empty table gives an empty result.
    """
    src = plain_docs(docs)
    left = {k: _blanked("text", k, p, NEEDS[k] if k != "email" else "@").alias(f"t_{k}") for k, p in BASE.items()}
    raw = src.select("doc_id", "text", *[_found("text", k, p, NEEDS[k] if k != "email" else "@").alias(f"b_{k}") for k, p in BASE.items()], *left.values())
    raw = raw.select("doc_id", *[f"b_{k}" for k in BASE], *[_found(f"t_{k}" if k in BASE else "text", k, p, NEEDS[k]).alias(f"c_{k}") for k, p in MORE.items()])
    base = F.concat(*[F.filter(f"b_{k}", _checks(k)) for k in BASE])
    slim = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _votes(x).alias("v")))
    voted = raw.select("doc_id", slim(base).alias("base"), slim(F.concat(*[f"c_{k}" for k in MORE])).alias("new"))
    voted = Stage(docs.sparkSession, "pii").put(voted, "voted")
    seen = voted.select(F.explode(F.concat("base", "new")).alias("x")).groupBy("x.v").count().collect()  # 5 x 3**5 x 45 rows at most, a few hundred in practice
    patterns = {r["v"]: r["count"] for r in seen}
    score = classifier(patterns, reliabilities(patterns))
    accept = sorted(p for p, s in score.items() if s >= 0.5)
    bare = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return voted.select("doc_id", bare("base").alias("base"), bare(F.filter("new", lambda x: x["v"].isin(accept))).alias("added"))


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find``'s spans."""
    order = F.create_map(*[v for i, k in enumerate(KINDS) for v in (F.lit(k), F.lit(i))])
    ranked = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(order[x["kind"]].alias("i"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    joined = lambda a: F.array_join(F.transform(ranked(a), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
