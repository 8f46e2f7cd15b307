"""Personal data: fixed patterns, and terms that give a protected entity away.

The patterns find e-mail addresses, IP addresses, card and phone numbers. Every
value found is a protected entity. A term (a word of letters or digits) reveals
an entity as far as the corpus says that who reads the term can infer the
entity: by pointwise mutual information, PMI = log2(N * joint / (df * de)), over
the information of the entity itself, log2(N / de). All four count different
texts, so copies count once: `joint` those that hold the entity and, anywhere,
the term, `de` those that hold the entity, `df` those of the whole corpus that
hold the term, N all. A term that is in texts of at least `LEAST` contexts of an
entity (the `NEAR` words on either side), with a share of `REMOVE` or more, is
removed wherever it stands in documents that hold the entity; from `GENERALISE`
on it is replaced by its kind. A passage that is copied with its entity is one
context, so mere duplication reveals nothing.

The first pass over the texts finds spans and contexts. Entities of fewer than
`LEAST` contexts can't be revealed. The terms of the other entities' texts are joined
with the entities, and what stays are pairs with as many contexts; only the terms of
those pairs are then counted over all texts (a bitmap of fixed size drops the others
inside the task, a join the few that it lets through). All counts are groupings with
partial sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.shared import bitmap, cut, marked, packed, schema_of, text_column, text_hashes, unpacked
from helioframe.llm.words import U, pieces

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that are its context, by which copied passages are known.
NEAR = 8
#: Contexts that must agree, and shares of the entity's information.
LEAST, GENERALISE, REMOVE = 3, 0.8, 0.9

# Fixed patterns. Guards and possessive repeats only save vain tries; the matches are the same.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TERM = re.compile(r"[^\W_]+")
#: A term's bytes, whatever they are, are one word.
WHOLE = np.ones(256, bool)
#: Terms that a task holds before it adds them up.
FLUSH = 2_000_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a local part and a domain, found from each @ outwards."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := AT.match(text, at)):
            last = m.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def entity(kind: str, value: str) -> str:
    """A value in one spelling."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{re.sub('[^0-9]', '', value)}"


def contexts(text: str, spans: list[tuple[int, str, int]]) -> list[dict]:
    """Each entity with the words around it."""
    found = []
    for start, kind, end in spans:
        # Bounded slices: a context only tells places apart.
        left, right = max(0, start - 40 * NEAR), min(len(text), end + 40 * NEAR)
        around = TERM.findall(text, left, start)[-NEAR:] + TERM.findall(text, end, right)[:NEAR]
        found.append({"entity": entity(kind, text[start:end]), "context": " ".join(around).lower()})
    return found


def free_terms(text: str) -> list[tuple[int, str, int]]:
    """(start, term, end) of every term of three characters or more outside the base spans."""
    found, taken, at = [], base_spans(text), 0
    taken = sorted((s, e) for s, _, e in taken)
    covered = 0
    for m in TERM.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][0] < end:
            covered = max(covered, taken[at][1])
            at += 1
        if end - start > 2 and covered <= start:
            found.append((start, m[0].lower(), end))
    return found


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
FOUND = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.string())]))
SHAPE = ("spans array<struct<start: int, kind: string, end: int>>, "
         "found array<struct<entity: string, context: string>>")


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces text by its base spans and what stands around them."""
    for batch in batches:
        spans, found = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            own = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
            found.append(contexts(text, own) if own else [])
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [
            pa.array(spans, pa.list_(SPAN)), pa.array(found, FOUND)], [*keep, "spans", "found"])


def terms_of(text: str) -> set[str]:
    """The different terms of a text, each in lower case; finding and counting both use these."""
    return {x.lower() for x in TERM.findall(text)}


def hashes_of(terms: list[str]) -> np.ndarray:
    """64 bits for each term."""
    found = [np.zeros(0, U)] + [words.hashes() for _, _, words in pieces(pa.array(terms, pa.string()), WHOLE)]
    return np.concatenate(found)


def own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, hash) of every different term of a text that could be removed."""
    for batch in batches:
        places, terms = [], []
        for i, text in enumerate(batch.column("text")):
            own = {x for _, x, _ in free_terms(text.as_py())}
            terms += own
            places += [i] * len(own)
        take = pa.array(places, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("t1").take(take), batch.column("t2").take(take),
                                          pa.array(hashes_of(terms).view(np.int64))], ["t1", "t2", "hash"])


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, added): the spans of all occurrences of a text's disclosing terms, `told`."""
    for batch in batches:
        added = []
        for text, told in zip(batch.column("text"), batch.column("told")):
            share = {x["hash"]: x["share"] for x in told.as_py()}
            terms = free_terms(text.as_py())
            hashes = hashes_of([x for _, x, _ in terms]).view(np.int64).tolist()
            added.append([{"start": s, "kind": "term" if share[h] >= REMOVE else "general", "end": e}
                          for (s, _, e), h in zip(terms, hashes) if h in share])
        yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(added, pa.list_(SPAN))],
                                         ["t1", "t2", "added"])


def texts_with(known: np.ndarray):
    """(hash, n): in how many of some texts each marked term is, once for each task."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        hashes, n = (np.concatenate(c) for c in zip(*parts))
        hashes, at = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(hashes), np.int64)
        np.add.at(total, at, n)
        return hashes, total

    def out(parts: list) -> pa.RecordBatch:
        hashes, n = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            terms: list[str] = []
            for text in batch.column("text"):
                terms += terms_of(text.as_py() or "")
            found = hashes_of(terms)
            found = found[marked(known, found)]
            parts.append((found, np.ones(len(found), np.int64)))
            held += len(found)
            if held >= FLUSH:  # what a task holds grows with different terms, not with texts
                parts = [merged(parts)]
                held = 0
                if len(parts[0][0]) >= FLUSH // 2:
                    yield out(parts)
                    parts = []
        if parts:
            yield out(parts)

    return run


def different(texts: DataFrame) -> DataFrame:
    """(t1, t2, text): each text once."""
    return texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))


def disclosing(held: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, hash, share) of the terms that reveal an entity.

    `held` has (entity, context, t1, t2, de), `own` has (t1, t2, hash) of those texts'
    terms, which are counted over all `texts` (t1, t2, text).
    """
    total = float(texts.select("t1", "t2").distinct().count())
    # Each text's terms with each of its entities; contexts in which a text has an entity come as a list.
    near = held.groupBy("t1", "t2", "entity", "de").agg(F.collect_set("context").alias("contexts"))
    pairs = own.join(near, ["t1", "t2"])
    # A text counts once for a pair, with all its contexts.
    enough = (pairs.select("entity", "hash", "de", F.explode("contexts").alias("context")).groupBy("entity", "hash", "de", "context")
              .agg(F.lit(1).alias("one")).groupBy("entity", "hash", "de").agg(F.count("one").alias("n")).where(f"n >= {LEAST}").drop("n"))
    joint = cut(pairs.groupBy("entity", "hash", "de").agg(F.count(F.lit(1)).alias("joint"))
                .join(enough, ["entity", "hash", "de"], "left_semi"))
    known = joint.select("hash").distinct()
    df = (different(texts).select("text").mapInArrow(texts_with(bitmap(known)), "hash long, n long")
          .groupBy("hash").agg(F.sum("n").alias("df")))
    joint = joint.join(df, "hash")
    return (joint.withColumn("share", F.log2(F.lit(total) * F.col("joint") / (F.col("de") * F.col("df")))
                             / F.greatest(F.log2(F.lit(total) / F.col("de")), F.lit(1e-9)))
            .where(F.col("share") >= GENERALISE).select("entity", "hash", "share"))


def added_spans(rows: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(t1, t2, added) of the texts with disclosing terms, or None where no entity has enough contexts."""
    near = rows.select("t1", "t2", F.explode("found").alias("f")).select("t1", "t2", "f.*").distinct()
    per_entity = (near.groupBy("entity").agg(F.countDistinct("t1", "t2").alias("de"),
                                             F.countDistinct("context").alias("n"))
                  .where(f"n >= {LEAST}").select("entity", "de"))
    held = cut(near.join(per_entity, "entity"))
    wanted = cut(held.select("t1", "t2").distinct())
    if not wanted.take(1):
        return None
    some = cut(different(texts.join(wanted, ["t1", "t2"], "left_semi")))
    own = cut(some.mapInArrow(own_terms, "t1 long, t2 long, hash long"))
    told = (held.select("t1", "t2", "entity").distinct().join(disclosing(held, own, texts), "entity")
            .groupBy("t1", "t2", "hash").agg(F.max("share").alias("share"))
            .groupBy("t1", "t2").agg(F.collect_list(F.struct("hash", "share")).alias("told")))
    return cut(some.join(told, ["t1", "t2"]).mapInArrow(
        occurrences, "t1 long, t2 long, added array<struct<start: int, kind: string, end: int>>"))


def private_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` and `spans`: all spans by start, kind and end, for every row.

    The kinds are email, ip, card, phone, then `general` and `term` for terms
    of a document with an entity that are to be generalised or removed, at every
    place; base spans always stay. Places are code points, the end is exclusive. Kinds may overlap. Null
    and empty texts have no spans. Repeated rows get equal spans and add no
    evidence. A kept column named spans gives way to the result's. An empty table
    stays empty.
    """
    kept, row = packed(keep, ("spans",))
    read = docs.select(row, *text_hashes(text_column()), text_column().alias("text"))
    rows = cut(read.mapInArrow(scan, schema_of(read, ["row", "t1", "t2"], SHAPE)))
    told = added_spans(rows.where(F.size("found") > 0), read.select("t1", "t2", "text"))
    rows = rows.select("row", "t1", "t2", "spans")
    rows = rows.withColumn("added", F.lit(None).cast("array<struct<start: int, kind: string, end: int>>")) \
        if told is None else rows.join(told, ["t1", "t2"], "left")
    rank = lambda s: F.array_position(F.lit([*KINDS, "general", "term"]), s["kind"])
    order = lambda x, y: (F.when(x["start"] != y["start"], x["start"] - y["start"])
                          .otherwise((rank(x) - rank(y)).cast("int")))
    return rows.select(
        *unpacked(kept), F.when(F.col("added").isNull(), F.col("spans"))
        .otherwise(F.array_sort(F.concat("spans", "added"), order)).alias("spans"))


def sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces text and spans by the sanitised text.

    Base spans become their kind in brackets, removed terms vanish, generalised
    ones become [number] or [word]. Of overlapping spans the first counts and
    covers them all.
    """
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            text, parts, at = text.as_py() or "", [], 0
            for s in spans.as_py() or ():
                if s["start"] >= at:
                    parts.append(text[at:s["start"]])
                    parts.append({"term": "", "general": "[number]" if text[s["start"]].isdigit() else "[word]"}
                                 .get(s["kind"], f"[{s['kind']}]"))
                at = max(at, s["end"])
            out.append("".join([*parts, text[at:]]))
        keep = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(out, pa.string())],
                                         [*keep, "text"])
