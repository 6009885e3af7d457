"""Personal data: fixed forms, and bootstrapped contextual extraction of further identifiers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, drop_spilled, spill, text_of

KINDS = ("email", "ip", "card", "phone")
_EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]+")
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does: from inside a run it would end alike, and no match ends inside one.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A stretch of the characters that numbers are made of; no ip, card or phone leaves its stretch.
_ZONE = re.compile(r"[+0-9][\x20().0-9+-]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]+")
_SPACES = re.compile(r"[\x20\x09-\x0D]")
_CAPITALS = re.compile(r"[A-Z]+")
#: Seeds of the kind secret, which has no fixed form in KINDS: a published key form, and values given to a telling name.
_SECRET = re.compile(r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16})(?![A-Za-z0-9])|(?<![a-z])(?:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?[\"']?([A-Za-z0-9_+/-]{8,100})", re.I)
ALL_KINDS = (*KINDS, "secret")
#: Characters of an instance; words of a number written in several.
SHORTEST, LONGEST, WORDS = 4, 200, 4
_EDGE = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _part(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) <= 3 and int(x or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """As leftmost matches of the whole pattern from the left, found from each @: its local part is the run before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > free and _EMAIL_LEFT.match(text, lo - 1, lo):
            lo -= 1
        m = _EMAIL_RIGHT.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed forms, by kind as listed, then start."""
    found: dict[str, list] = {k: [] for k in KINDS}
    found["email"] = emails(text)
    for zone in _ZONE.finditer(text):
        lo, hi = zone.span()
        if hi - lo < 7:
            continue
        for m in _IP.finditer(text, lo, hi):
            if all(map(_part, m.group().split("."))):
                found["ip"].append(m.span())
        for m in _CARD.finditer(text, lo, hi):
            digits = "".join(_DIGITS.findall(m.group()))
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        for m in _PHONE.finditer(text, lo, hi):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                found["phone"].append(m.span())
    return [(k, *span) for k in KINDS for span in found[k]]


def secrets(text: str) -> list[tuple[int, int]]:
    """Seeds of the kind secret: values that hold a digit."""
    found = [m.span(1) if m.group(1) else m.span(2) for m in _SECRET.finditer(text)] if _DIGITS.search(text) else []
    return [(lo, hi) for lo, hi in found if _DIGITS.search(text, lo, hi)]


def plausible(token: str) -> list[str]:
    """The kinds that a token which is no base match could be an identifier of, written otherwise."""
    digits = len(_DIGITS.findall(token))
    out = ["email"] if "@" in token.strip("@") and len(token) >= 5 else []
    if digits >= 4 and len(_NUMBER.findall(token)) == 4:
        out.append("ip")
    if digits >= 7 and digits * 2 >= len(token):
        out += ["card"] * (13 <= digits <= 19) + ["phone"] * (digits <= 15)
    if digits >= 2 and len(token) >= 8 and len(token) - digits >= 2 and "@" not in token and not _SPACES.search(token):
        out.append("secret")
    return out


def shape(token: str) -> str:
    """The form of a token: digits as 0, runs of letters as a or A, all else as it is."""
    return _CAPITALS.sub("A", _LETTERS.sub("a", _DIGITS.sub("0", token)))


def _patterns(text: str, lo: int, hi: int, width: int) -> list[str]:
    """Lexical patterns of a span, from general to special: its own form, what stands before it in its word, the word
    before, the words around. Found in what borders the span; words are lower-cased, digits written as 0."""
    before = _WORD.findall(text[max(0, lo - 40 * width) : lo])
    after = _WORD.search(text, hi, min(len(text), hi + 60))
    plain = lambda w: _DIGITS.sub("0", " ".join(w).lower())
    out = ["form " + shape(text[lo:hi])]
    glued = lo > 0 and text[lo - 1] not in " \t\n\x0b\x0c\r"
    if glued:
        out.append("glued " + plain([before[-1][-20:]]))
    if before:
        out.append("left " + plain([before[-1]]))
        out.append("around " + plain([*before[-width:], "_", after.group() if after else ""]))
    return out


def _outside(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of spans, sorted by start, that touch none of taken, sorted and apart or not."""
    out, at, reach = [], 0, -1
    for lo, hi in spans:
        while at < len(taken) and taken[at][0] <= lo:
            reach, at = max(reach, taken[at][1]), at + 1
        if reach <= lo and not (at < len(taken) and taken[at][0] < hi):
            out.append((lo, hi))
    return out


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that may be identifiers and touch none of taken: words with a digit or an @, without what stands at their
    edges and in front of a = or :, and up to WORDS neighbouring words of a stretch of number characters."""
    if "@" not in text and not _DIGITS.search(text):
        return []
    found = set()
    for m in _WORD.finditer(text):
        token = m.group()
        if "@" not in token and not _DIGITS.search(token):
            continue
        lo = m.start() + len(token) - len(token.lstrip(_EDGE))
        hi = m.end() - len(token) + len(token.rstrip(_EDGE))
        found.add((lo, hi))
        cut = max(token.find("="), token.find(":"))
        if cut > 0:
            found.add((m.start() + cut + 1 + len(token[cut + 1 :]) - len(token[cut + 1 :].lstrip(_EDGE)), hi))
    for zone in _ZONE.finditer(text):
        parts = [m.span() for m in _WORD.finditer(text, *zone.span())] if zone.end() - zone.start() >= 7 else []
        digits = [len(_DIGITS.findall(text, *p)) for p in parts]
        for k, (lo, _) in enumerate(parts):
            found |= {(lo, parts[j][1]) for j in range(k, min(k + WORDS, len(parts))) if sum(digits[k : j + 1]) >= 7}
    return _outside(sorted(x for x in found if SHORTEST <= x[1] - x[0] <= LONGEST), taken)


def occurrences(text: str, width: int) -> tuple[list, list]:
    """Base spans, and the instances of the pattern graph: (kind, start, end, value, patterns, kinds) of base spans and
    seeds of secrets, and of candidates with kind null; kinds: those that a candidate is plausible for."""
    spans = base_spans(text)
    taken = sorted((lo, hi) for _, lo, hi in spans)
    seeds = spans + [("secret", lo, hi) for lo, hi in _outside(secrets(text), taken)]
    made = [(kind, lo, hi, text[lo:hi].lower()[:LONGEST], _patterns(text, lo, hi, width), []) for kind, lo, hi in seeds]
    for lo, hi in candidates(text, sorted((lo, hi) for _, lo, hi in seeds)):
        kinds = plausible(text[lo:hi])
        if kinds:
            made.append((None, lo, hi, text[lo:hi].lower(), _patterns(text, lo, hi, width), kinds))
    return spans, made


@dataclass(frozen=True)
class BootstrapOptions:
    """width: words of left context; rounds: of scoring; min_seeds: different accepted values that make a pattern;
    trusted: least confidence of a pattern that says something of its instances; confident: least score of an instance
    that is accepted."""

    width: int = 2
    rounds: int = 3
    min_seeds: int = 3
    trusted: float = 0.5
    confident: float = 0.8


def _edges(rows: DataFrame) -> DataFrame:
    """(pattern, kind, value, seed) with a row per distinct edge of the pattern-instance graph; a candidate stands under
    every kind it is plausible for."""
    seen = rows.select(F.explode("instances").alias("x")).select("x.*")
    seeds = seen.filter("kind IS NOT NULL").select(F.explode("patterns").alias("pattern"), "kind", "value", F.lit(True).alias("seed"))
    others = seen.filter("kind IS NULL").select("patterns", F.explode("kinds").alias("kind"), "value")
    others = others.select(F.explode("patterns").alias("pattern"), "kind", "value", F.lit(False).alias("seed"))
    return seeds.unionByName(others).distinct()


def scored_instances(edges: DataFrame, o: BootstrapOptions) -> DataFrame:
    """(kind, value, score) of the candidates that are accepted.

    A pattern's confidence is the share of its distinct values that are accepted; patterns of fewer than min_seeds
    accepted values, or of less confidence than trusted, say nothing. A candidate's score is 1 - prod(1 - confidence)
    over its patterns; it is accepted from ``confident`` on. Seeds are accepted from the start, and what one round
    accepts supports, and makes, patterns in the next. Each round is written as a table.
    """
    graph = spill(edges)
    accepted = spill(graph.filter("seed").select("kind", "value", F.lit(1.0).alias("score")).distinct())
    for _ in range(o.rounds):
        known = graph.join(accepted, ["kind", "value"], "left")
        patterns = known.groupBy("pattern", "kind").agg(F.count("score").alias("yes"), F.count(F.lit(1)).alias("all"))
        patterns = patterns.select("pattern", "kind", (F.col("yes") / F.col("all")).alias("confidence"), "yes")
        patterns = patterns.filter((F.col("yes") >= o.min_seeds) & (F.col("confidence") >= o.trusted))
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))))
        new = graph.filter(~F.col("seed")).join(patterns, ["pattern", "kind"]).groupBy("kind", "value").agg((1 - doubt).alias("score")).filter(F.col("score") >= o.confident)
        seeds = graph.filter("seed").select("kind", "value", F.lit(1.0).alias("score")).distinct()
        before, accepted = accepted, spill(seeds.unionByName(new.join(seeds.select("kind", "value"), ["kind", "value"], "left_anti")))
        drop_spilled(before)
    return spill(accepted.join(graph.filter("seed").select("kind", "value"), ["kind", "value"], "left_anti"))


def _apart(batches) -> Iterator:
    """Of discovered spans of a document, the best of those that overlap: by score, then length, then start."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for more in batch.column("more").to_pylist():
            more = sorted(more, key=lambda x: (-x["score"], x["start"] - x["end"], x["start"], x["kind"]))
            starts, kept = [], {}
            for x in more:
                at = bisect_left(starts, x["start"])
                before = at and kept[starts[at - 1]]["end"] > x["start"]
                if not before and not (at < len(starts) and starts[at] < x["end"]):
                    starts.insert(at, x["start"])
                    kept[x["start"]] = x
            out.append([kept[k] for k in starts])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, batch.schema.field("more").type)], ["row", "more"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: BootstrapOptions | None = None) -> DataFrame:
    """Spans of personal data: (id, base, found), arrays of (kind, start, end) in code points, end exclusive.

    base holds the matches of the fixed forms, by kind as listed in KINDS, then start; found adds secrets and the
    bootstrapped identifiers to them. Base matches and seeds of secrets induce lexical patterns: their own form, the
    words around them, what they are glued to. The graph of patterns and instances is scored in rounds, and what is
    accepted in the end is marked wherever it stands as a candidate. Candidates have 4 to 200 characters with a digit or
    an @, touch no seed, and are words or numbers written in up to four words; of candidates that overlap the best stays.
    Every row gives one row, in one pass over the texts that takes time in proportion to their length; what the graph
    holds are the few candidates. Null and empty texts have no spans; repeated rows and null ids are rows like others;
    no rows give no rows; other columns are ignored.
    """
    o = options or BootstrapOptions()

    def run(batches) -> Iterator:
        import pyarrow as pa

        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string())), ("kinds", pa.list_(pa.string()))])
        names = ("kind", "start", "end", "value", "patterns", "kinds")
        for batch in arrow_slices(batches, "text"):
            bases, items = [], []
            for text in batch.column("text").to_pylist():
                spans, made = occurrences(text, o.width)
                bases.append([dict(zip(names[:3], s, strict=True)) for s in spans])
                items.append([dict(zip(names, x, strict=True)) for x in made])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bases, pa.list_(span)), pa.array(items, pa.list_(item))], ["id", "base", "instances"])

    kind = "id long, base array<struct<kind: string, start: long, end: long>>, instances array<struct<kind: string, start: long, end: long, value: string, patterns: array<string>, kinds: array<string>>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, kind)
    rows = spill(rows.withColumn("row", F.monotonically_increasing_id()))
    accepted = scored_instances(_edges(rows), o)
    seen = rows.select("row", F.explode("instances").alias("x")).select("row", "x.*")
    new = seen.filter("kind IS NULL").select("row", "start", "end", "value", F.explode("kinds").alias("kind")).join(accepted, ["kind", "value"])
    new = new.unionByName(seen.filter("kind = 'secret'").select("row", "start", "end", "value", "kind", F.lit(1.0).alias("score")))
    more = new.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "score")).alias("more"))  # of one document
    more = more.mapInArrow(_apart, more.schema)
    out = rows.select("row", "id", "base").join(more, "row", "left")
    listed = F.array(*[F.lit(k) for k in ALL_KINDS])
    none = F.array().cast("array<struct<kind: string, start: long, end: long>>")
    added = F.coalesce(F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), none)
    both = F.transform(F.concat("base", added), lambda s: F.struct(F.array_position(listed, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    found = F.transform(F.array_sort(both), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(F.col("id").alias(id_col), "base", found.alias("found"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    d = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *map(count, KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("found").alias("spans"), F.size("found").cast("long").alias("n_found"))
