"""Every operator against a plain version, over whole tables and over odd rows."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.llm import (contamination, fuzzy_lines, mixing, near_duplicates, private, quality, queries, repeats,
                            revisits, shared, sharding, token_counts)
from helioframe.llm.components import components
from tests.llm import brute


@pytest.fixture(scope="module")
def documents(spark, sf):
    rows = queries.table(spark, sf, "documents").select("doc_id", "text", "source", "lang").collect()
    return [tuple(r) for r in rows]


def rows_of(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


def decontaminated(frame):
    return rows_of(frame.withColumn("sha", F.sha2(F.array_join("items", ","), 256)),
                   "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated")


def test_decontamination(spark, sf, documents):
    found = queries.op1_decontamination(spark, sf)
    items = [tuple(r) for r in queries.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    want = brute.contamination([d[:2] for d in documents], items)
    assert rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") \
        == sorted(want, key=repr)
    assert any(r[-1] for r in want)


def test_decontamination_of_odd_rows(spark, docs_of, odd):
    items = [(1, None), (2, ""), (3, "One!"), (4, "A b, c d"), (5, "a b c d e"), (None, "lone text"),
             (6, "same text " * 9), (6, "same text " * 9), (7, "ünïcödé wörds")]
    rows = odd + [(20, "x a B c; d e a b c d e"), (21, "one one")]
    found = contamination.decontaminate(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"),
                                        ["doc_id"])
    want = brute.contamination(rows, items)
    for k, row in enumerate(want):  # an item without an id hits, but has no id to count
        if row[0] is None and rows[k][1].startswith("a lone"):
            want[k] = (None, row[1], row[2], 0, brute.sha(""), row[5])
    assert decontaminated(found) == sorted(want, key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r[2] == 0 for r in decontaminated(contamination.decontaminate(docs_of(rows), none, ["doc_id"])))
    assert contamination.decontaminate(docs_of([]), none, ["doc_id"]).count() == 0


def test_targets(spark):
    sizes = {"a": 100, "b": 5000, None: 300, "c": 0, "d": 40, "é": 7}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    names = sorted([k for k in sizes if k is not None]) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    left, open_, want = 1.5 * sum(sizes.values()), set(names), {}
    while True:  # plainly: give out by weight, stop what is above, again
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        above = [k for k in open_ if share[k] > 2 * sizes[k]]
        if not above:
            want |= share
            break
        for k in above:
            want[k] = 2.0 * sizes[k]
            left -= want[k]
            open_.remove(k)
    got = dict(tuple(r) for r in mixing.targets(frame, (3, 1, 2), 1.5, 2.0).select("source", "target").collect())
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_mixing(spark, docs_of, odd):
    r = random.Random(5)
    rows = [(i, "w " * r.randrange(1, 60), "abc"[min(2, r.randrange(5))]) for i in range(900)]
    rows += [(i, t, "d" if len(t or "") > 10_000 else "a") for i, t in odd]  # two very long ones are a source
    docs = docs_of(rows)
    found = mixing.mix(docs, bucket=100)
    got = rows_of(found, "doc_id", "source", "mix.size", "mix.source_size", "mix.target", "mix.copies")
    assert [g[:3] for g in got] == sorted([(d[0], d[2] if len(d) > 2 else "a", len(brute.words(d[1])))
                                           for d in rows], key=repr)
    assert set(found.columns) == set(docs.columns) | {"mix"}
    taken, target = defaultdict(int), {}
    for _, source, size, _, goal, copies in got:
        assert 0 <= copies <= 2
        taken[source] += size * copies
        target[source] = goal
    assert all(abs(taken[s] - target[s]) < (150 if s != "d" else 60_002) for s in target)
    # Documents are balanced as well as words, and another partitioning decides alike.
    assert rows_of(mixing.mix(docs.repartition(7), bucket=100), "doc_id", "source", "mix.size", "mix.source_size",
                   "mix.target", "mix.copies") == got
    whole = mixing.mixed(docs, bucket=100)
    assert whole.columns == docs.columns
    assert whole.count() == sum(g[5] for g in got)
    assert mixing.mix(docs_of([])).count() == 0


def test_equal_rows_share_their_copies_out(spark, docs_of):
    """A thousand equal rows at a fractional rate come within one document of the target."""
    r = random.Random(8)
    rows = [(None, "w " * 10, "a")] * 1000 + [(i, "w " * r.randrange(1, 30), "bc"[i % 2]) for i in range(400)]
    for part in (mixing.BUCKET, 70):
        got = mixing.mix(docs_of(rows), bucket=100)
        units = got.where("source = 'a'").select("mix.size", "mix.target", "mix.copies").collect()
        assert len(units) == 1000 and {x.copies for x in units} <= {0, 1, 2}
        assert max(x.copies for x in units) - min(x.copies for x in units) <= 1
        assert abs(sum(x.size * x.copies for x in units) - units[0].target) <= 10
        alike = spark.createDataFrame([(i // 90, i % 90, 90, 31) for i in range(900)], "unit long, row long, rows long, copies long")
        dealt = mixing.dealt(alike, part).groupBy("unit").agg(F.sum("copies").alias("n"), F.max("copies").alias("most")).collect()
        assert all(x.n == 31 and x.most == 1 for x in dealt) and len(dealt) == 10
    with_map = docs_of(rows[:1100]).withColumn("more", F.create_map(F.lit("k"), F.col("lang")))
    assert mixing.mix(with_map).count() == 1100


def test_flight_keeps_totals_and_expectations():
    r = random.Random(3)
    for _ in range(200):
        held = [[r.uniform(.05, .95), r.randrange(1, 9), r.randrange(1, 3), None, None, 0] for _ in range(3)]
        before = [sum(u[0] * u[k] for u in held) for k in (1, 2)]
        mixing.move(held, r.random(), 1)
        assert [sum(u[0] * u[k] for u in held) for k in (1, 2)] == pytest.approx(before)
        assert any(u[0] in (0.0, 1.0) for u in held) and all(0 <= u[0] <= 1 for u in held)
    ends = Counter()
    for i in range(4000):
        held = [[0.3, 5, 1, None, None, 0]]
        mixing.move(held, (i + .5) / 4000, 1)
        ends[held[0][0]] += 1
    assert ends[1.0] == pytest.approx(1200, abs=2)


def test_substring_dedup(spark, sf, documents):
    found = queries.op3_substring_dedup(spark, sf)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") \
        == sorted(brute.repeats([d[:2] for d in documents]), key=repr)


def test_substring_dedup_of_odd_rows(docs_of, odd):
    r = random.Random(2)
    passage = " ".join(str(r.random()) for _ in range(50))
    rows = odd + [(30, "x " + passage), (31, passage + "\t\ty"), (32, " ".join(passage.split()[3:38]) + " z"),
                  (33, " ".join(passage.split()[:34]))] + [(40 + i, f"{i} {passage} {i}") for i in range(60)]
    found = repeats.remove_repeats(docs_of(rows).repartition(5), ["doc_id"]).withColumn("sha", F.sha2("kept_text", 256))
    assert rows_of(found, "doc_id", "n_words", "n_removed", "sha") == sorted(brute.repeats(rows), key=repr)
    assert repeats.remove_repeats(docs_of([]), ["doc_id"]).count() == 0


def test_sketch_loses_no_repeated_window(spark, docs_of):
    r = random.Random(4)
    texts = [" ".join(r.choice("abc") for _ in range(120)) for _ in range(30)]
    bits = repeats.count_min(docs_of(list(enumerate(texts))).select("text"), 6)
    import pyarrow as pa

    from helioframe.llm.words import pieces
    seen = Counter(tuple(t.split()[p:p + 6]) for t in texts for p in range(115))
    for _, _, w in pieces(pa.array(texts)):
        starts, hashes, _ = repeats.anchors(w, 6)
        for p, maybe in zip(starts, repeats.suspected(bits, hashes)):
            assert maybe or seen[tuple(w.word(i).decode() for i in range(p, p + 6))] == 1


def test_near_duplicates(spark, sf, documents):
    found = queries.op8_jaccard_join(spark, sf)
    docs = sorted(d[:2] for d in documents)
    want = [(docs[i][0], n, docs[c][0]) for i, (n, c) in enumerate(brute.near(docs))]
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert any(a != c for a, _, c in want)


def test_near_duplicates_of_odd_rows(docs_of, odd):
    """Chains of copies that differ a little more each time, of every size from 4 shingles on."""
    r = random.Random(8)
    rows = list(odd)
    for n in [8, 9, 10, 14, 20, 33, 60, 100, 180, 260, 400]:
        base = [f"{n}v{r.random()}" for _ in range(n)]
        for k in range(6):
            rows.append((1000 * n + k, " ".join(base)))
            base = list(base)
            base[r.randrange(n)] = f"new{r.random()}"
            base += [f"more{r.random()}"] * (n > 50) * (k % 2)
    rows = [x for x in rows if x[0] is not None]
    order = sorted(rows, key=lambda x: x[0])
    want = [(order[i][0], n, order[c][0]) for i, (n, c) in enumerate(brute.near(order))]
    found = near_duplicates.near_duplicates(docs_of(rows), ["doc_id"])
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    lone = near_duplicates.near_duplicates(docs_of([(None, "a b c d e f"), (None, "a b c d e f"), (None, None)]),
                                           ["doc_id"])
    assert rows_of(lone, "n_shingles", "component_id") == [(0, None), (2, None), (2, None)]
    assert near_duplicates.near_duplicates(docs_of([]), ["doc_id"]).count() == 0


def test_a_large_group_of_borderline_copies(docs_of):
    r = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    rows = [(i, " ".join(w if r.random() > .02 else f"e{r.random()}" for w in base)) for i in range(120)]
    rows += [(200 + i, " ".join(f"o{r.random()}" for _ in range(60)) + " " + " ".join(base[:40])) for i in range(60)]
    found = near_duplicates.near_duplicates(docs_of(rows), ["doc_id"])
    want = [(rows[i][0], n, rows[c][0]) for i, (n, c) in enumerate(brute.near(rows))]
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_texts_that_are_half_boilerplate(docs_of, monkeypatch):
    """Half of every text is one passage: nothing of it is similar but the planted pairs, and few pairs are tried."""
    r = random.Random(12)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for i in range(400):
        own = [f"x{i}w{k}" for k in range(300)]
        rows.append((i, " ".join(passage + own)))
        if i % 40 == 0:  # with a near copy
            own = [w if r.random() > .02 else f"e{r.random()}" for w in own]
            rows.append((1000 + i, " ".join(passage + own)))
    tried, verified = [], near_duplicates.verified

    def counted(texts, nodes, pairs):
        tried.append(pairs.count())
        return verified(texts, nodes, pairs)

    monkeypatch.setattr(near_duplicates, "verified", counted)
    found = near_duplicates.near_duplicates(docs_of(rows), ["doc_id"])
    want = [(rows[i][0], n, rows[c][0]) for i, (n, c) in enumerate(brute.near(rows))]
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    # A few hubs for each block at first, then nothing that is left to try.
    assert len({c for _, _, c in want}) == 400 and tried[0] < 40 * len(rows) and sum(tried[1:]) < len(rows)


def test_long_texts_that_are_nearly_similar(docs_of, monkeypatch):
    """Each text has an eighth of its own elsewhere: every block is shared, no two texts are similar but the
    planted pairs, and pairs that differ too much are not given out at all."""
    r = random.Random(13)
    base = [f"b{i}" for i in range(1600)]
    rows = []
    for i in range(24):
        at = 66 * i
        own = base[:at] + [f"x{i}w{k}" for k in range(200)] + base[at + 200:]
        rows.append((i, " ".join(own[:1600])))
        if i % 8 == 0:  # with a near copy, a fifth shorter at most
            own = [w for w in own[:1600] if r.random() > .015]
            rows.append((1000 + i, " ".join(own)))
    tried, verified = [], near_duplicates.verified

    def counted(texts, nodes, pairs):
        tried.append(pairs.count())
        return verified(texts, nodes, pairs)

    monkeypatch.setattr(near_duplicates, "verified", counted)
    found = near_duplicates.near_duplicates(docs_of(rows), ["doc_id"])
    want = [(rows[i][0], n, rows[c][0]) for i, (n, c) in enumerate(brute.near(rows))]
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    groups = len({c for _, _, c in want})
    assert len(tried) == 2 and tried[1] < groups


def test_long_words_of_two_letters_differ(docs_of):
    """Two words whose polynomial hashes would agree whatever their base."""
    bits = [i.bit_count() & 1 for i in range(1024)]
    a, b = ("".join("ab"[x ^ k] for x in bits) for k in (0, 1))
    found = near_duplicates.near_duplicates(docs_of([(1, a), (2, b)]), ["doc_id"])
    assert rows_of(found, "doc_id", "component_id") == [(1, 1), (2, 2)]
    start = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{start} {a}"), (2, f"{start} {b}")]
    assert rows_of(repeats.remove_repeats(docs_of(rows), ["doc_id"]), "doc_id", "n_removed") == [(1, 0), (2, 0)]


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 560)]
    union = brute.Union()
    for a, b in links:
        union.join(a, b)
    want = {(x, union.find(x)) for a, b in links if a != b for x in (a, b)}
    assert {tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def test_sharding(spark, docs_of, odd):
    docs = docs_of(odd + [(7, "same")] * 40 + [(i, "t") for i in range(100, 900)])
    found = sharding.shard(docs)
    assert found.columns == [*docs.columns, "shard", "slot"]
    rows = found.select("doc_id", "shard", "slot").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    again = sharding.shard(docs.repartition(9))
    assert rows_of(again, "doc_id", "text", "shard", "slot") == rows_of(found, "doc_id", "text", "shard", "slot")
    assert rows_of(sharding.shard(docs_of([])), "doc_id") == []
    # One more shard moves little more than it takes.
    unique = docs.where("doc_id BETWEEN 100 AND 899").select("doc_id")
    few, more = (dict(rows_of(sharding.shard(unique, shards=n), "doc_id", "shard")) for n in (16, 17))
    assert sum(few[k] != more[k] for k in few) < 0.35 * len(few)


def test_overflow_is_placed_as_by_hand():
    # Arcs belong to shards 0, 1, 0, 1; the last count is the arc behind the last point.
    taken = sharding.place_overflow([5, 0, 0, 1, 1], [0, 1, 0, 1], [4, 3])
    assert taken == [(0, 0, 4, 0, 0), (3, 0, 1, 1, 0), (0, 4, 5, 1, 1), (4, 0, 1, 1, 2)]


def test_private_spans(spark, sf, documents):
    found = queries.op6_pii(spark, sf).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(documents)
    for doc, text, *_ in documents:
        spans = brute.private(text)
        said = ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
        row = by_id[doc]
        assert row.base_sha256 == brute.sha(said)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(x[1] == k for x in spans)
                                                                    for k in brute.PATTERNS]
        assert set(filter(None, said.split(","))) <= set(row.spans.split(","))


def test_disclosing_terms(docs_of, odd):
    r = random.Random(1)
    talk = lambda: " ".join(f"w{r.randrange(4000)}" for _ in range(12))
    rows = [(100 + i, f"{talk()} zorbley mails bob@x.org via {talk()}") for i in range(8)]
    rows += [(200 + i, f"{talk()} mails via {talk()}") for i in range(300)]
    rows += [(600 + i, "copy of one text quibble about amy@y.org quibble") for i in range(9)] + odd
    docs = docs_of(rows)
    found = private.private_spans(docs, ["doc_id", "text"])
    spans = {x.doc_id: x.spans for x in private.private_spans(docs, ["doc_id"]).collect()}
    for doc, text in rows[:8]:
        added = [text[s.start:s.end] for s in spans[doc] if s.kind in ("term", "general")]
        assert added == ["zorbley"]
    assert all(s.kind == "email" for doc, _ in rows[308:317] for s in spans[doc])  # copies are no evidence
    assert all(not spans[doc] for doc, _ in rows[8:308])
    assert found.count() == len(rows)
    clean = docs.join(private.private_spans(docs, ["doc_id"]), "doc_id").select("doc_id", "text", "spans").mapInArrow(
        private.sanitise, "doc_id long, text string")
    texts = {x.doc_id: x.text for x in clean.collect()}
    assert "[email]" in texts[100] and "zorbley" not in texts[100] and "bob" not in texts[100]
    assert private.private_spans(docs_of([]), ["doc_id"]).count() == 0


def added_terms(docs, rows):
    """doc_id with the disclosing terms of its row, by their places."""
    spans = {x.doc_id: x.spans for x in private.private_spans(docs, ["doc_id"]).collect()}
    return {doc: [text[s.start:s.end] for s in spans[doc] if s.kind in ("term", "general")] for doc, text in rows}


def plain_spans(rows):
    """All spans by counting entities, contexts and terms one text after the other."""
    texts = {t or "" for _, t in rows}
    held, has, df = defaultdict(lambda: defaultdict(set)), {}, Counter()
    for t in texts:
        df.update(private.terms_of(t))
        has[t] = {x for _, x, _ in private.free_terms(t)}
        for c in private.contexts(t, private.base_spans(t)):
            held[c["entity"]][t].add(c["context"])
    told = defaultdict(dict)
    for entity, where in held.items():
        if len(set().union(*where.values())) < private.LEAST:
            continue
        for term in set().union(*(has[t] for t in where)):
            both = [t for t in where if term in has[t]]
            if len(set().union(*(where[t] for t in both))) < private.LEAST:
                continue
            share = math.log2(len(texts) * len(both) / (len(where) * df[term])) / max(math.log2(len(texts) / len(where)), 1e-9)
            if share >= private.GENERALISE:
                for t in where:
                    told[t][term] = max(share, told[t].get(term, 0))
    rank = {k: i for i, k in enumerate([*private.KINDS, "general", "term"])}
    found = []
    for i, t in rows:
        spans = [(s, k, e) for s, k, e in private.base_spans(t or "")]
        spans += [(s, "term" if told[t or ""][x] >= private.REMOVE else "general", e)
                  for s, x, e in private.free_terms(t or "") if x in told[t or ""]]
        found.append((i, [tuple(x) for x in sorted(spans, key=lambda x: (x[0], rank[x[1]]))]))
    return sorted(found, key=repr)


def test_disclosing_terms_as_counted_plainly(docs_of, odd):
    """Entities that share texts, copies, terms of every rarity: all spans equal those of the plain count."""
    r = random.Random(21)
    people = [(f"p{k}@x{k}.org", [f"name{k}", f"street{k % 20}"]) for k in range(40)]
    rows = list(odd)
    for i in range(1500):
        words = [f"w{int(r.paretovariate(.6)) % 500}" for _ in range(r.randrange(4, 40))]
        for mail, names in r.sample(people, r.choice((0, 0, 1, 1, 2))):
            words.insert(r.randrange(len(words)), mail)
            for name in names:
                if r.random() < .8:
                    words.insert(r.randrange(len(words)), name)
        rows.append((100 + i, " ".join(words)))
    rows += [(5000 + i, rows[-1 - i][1]) for i in range(40)]
    found = private.private_spans(docs_of(rows), ["doc_id"]).collect()
    got = sorted([(x.doc_id, [(s.start, s.kind, s.end) for s in x.spans]) for x in found], key=repr)
    want = plain_spans(rows)
    assert got == want
    assert {k for _, spans in want for _, k, _ in spans} >= {"email", "general", "term"}


def test_copied_texts_hide_no_disclosing_term(docs_of):
    r = random.Random(11)
    talk = lambda: " ".join(f"w{r.randrange(9000)}" for _ in range(12))
    texts = [f"{talk()} zorbley mails bob@x.org via {talk()}" for _ in range(3)]
    rows = [(1000 + 10 * i + k, text) for i, text in enumerate(texts) for k in range(10)]
    rows += [(i, f"{talk()} mails via {talk()}") for i in range(270)]
    found = added_terms(docs_of(rows), rows)
    assert all(found[doc] == ["zorbley"] * (doc >= 1000) for doc, _ in rows)


def test_terms_beyond_ascii_disclose(docs_of):
    r = random.Random(12)
    talk = lambda: " ".join(f"w{r.randrange(9000)}" for _ in range(12))
    rows = [(100 + i, f"{talk()} ‘Иван’ Élan—zorbley mails bob@x.org via {talk()}") for i in range(6)]
    rows += [(200 + i, f"{talk()} «Große» große… amy@y.org {talk()}") for i in range(6)]
    # The entity's term is common elsewhere, in capitals and next to marks.
    rows += [(300 + i, f"{talk()} mails “GROßE” via {talk()}") for i in range(270)]
    found = added_terms(docs_of(rows), rows)
    assert all(found[doc] == ["Иван", "Élan", "zorbley"] * (doc < 200) for doc, _ in rows)


def test_disclosing_terms_far_from_the_entity(docs_of):
    r = random.Random(13)
    talk = lambda n=30: " ".join(f"w{r.randrange(90000)}" for _ in range(n))
    rows = [(100 + i, f"zorbley {talk()} {talk()} bob@x.org {talk()} Zorbley, {talk()}") for i in range(5)]
    rows += [(200 + i, f"quibbler {talk(9 + i)} one copied passage of eight words stands before amy@y.org and then goes on for nine more words") for i in range(5)]
    rows += [(300 + i, f"{talk()} mails via {talk()}") for i in range(270)]
    found = added_terms(docs_of(rows), rows)
    assert all([x.lower() for x in found[doc]] == ["zorbley"] * 2 * (doc < 200) for doc, _ in rows
               if not 200 <= doc < 300)
    # One copied passage is one context, however often it stands in other texts.
    assert all(found[200 + i] == [] for i in range(5))


def test_quality(spark, sf, documents):
    found = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    for doc, text, *_ in documents:
        want = brute.quality(text)
        row = found[doc]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (row.base_failed and row.kept)


def plain_mcd(x, r):
    """Center and precision of least determinant, from many starts by C-steps over exact subsets."""
    floor, best = np.diag([least ** 2 for _, least in quality.VECTOR]), (np.inf,)
    fit = lambda y: (y.mean(axis=0), np.cov(y.T, bias=True) * quality.CONSISTENT + floor)
    spread = np.subtract(*np.quantile(x, (.75, .25), axis=0)) / 1.349
    starts = [fit(x), (np.median(x, axis=0), np.diag(spread ** 2) + floor)]
    starts += [fit(x[r.choice(len(x), min(len(x), 30), replace=False)]) for _ in range(10)]
    for center, cover in starts:
        last = np.inf
        for _ in range(50):
            d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cover), x - center)
            center, cover = fit(x[np.argsort(d, kind="stable")[:int(np.ceil(quality.HALF * len(x)))]])
            if np.linalg.det(cover) >= last * (1 - 1e-12):
                break
            last = np.linalg.det(cover)
        best = min(best, (np.linalg.det(cover), center.tolist(), np.linalg.inv(cover).tolist()))
    return best[0], np.array(best[1]), np.array(best[2])


def test_outliers_as_computed_plainly(spark, odd):
    """Two languages with groups of their own, groups that fall back on their language, and on the corpus."""
    r, npr, rows = random.Random(4), np.random.default_rng(4), []

    def text(words, bad):
        lines = [" ".join(r.choice(words) for _ in range(r.randrange(5, 15))) for _ in range(r.randrange(3, 14))]
        if bad:
            lines += [" ".join(r.choice("#$%&|<>*") * r.randrange(4, 12) + r.choice(words) for _ in range(6)) for _ in range(r.randrange(6, 20))]
        return "\n".join(lines)

    for lang, source, n in (("en", "s", 300), ("en", "t", 20), ("fr", "u", 40), ("fr", "v", 30), ("de", None, 12), (None, "w", 80)):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9 if lang == "en" else 13))) for _ in range(400)]
        rows += [(len(rows) + k, text(words, r.random() < .12), lang, source) for k in range(n)]
    frame = spark.createDataFrame([(*x, "a", "b") for x in rows], "doc_id long, text string, lang string, source string, distance string, pair string")
    found = quality.judge(frame, ["doc_id", "distance", "pair"])
    assert found.columns == ["doc_id", "pair", *quality.BASE, "base_failed", "distance", "kept"]
    got = {x.doc_id: x for x in found.collect()}
    stats = np.array([brute.quality(t) for _, t, *_ in rows], float)
    n, chars, symbols, lines, again = stats.T
    x = np.stack([np.log(1 + n), (chars + 250) / (n + 50), np.sqrt(symbols / (chars + 100)), np.sqrt(lines / (n + 50)),
                  np.sqrt(again / (n + 50))], axis=1)
    members = defaultdict(list)
    for i, (_, _, lang, source) in enumerate(rows):
        small = sum(y[2:] == (lang, source) for y in rows) < quality.LEAST
        smaller = sum(y[2] == lang for y in rows) < quality.LEAST
        members["all" if small and smaller else lang if small else (lang, source)].append(i)
    assert len(members) == 5
    for key, own in members.items():
        pool = [i for i, y in enumerate(rows) if key == "all" or key == y[2] or key == y[2:]]
        _, center, precision = plain_mcd(x[pool], npr)
        for i in own:
            want = float((x[i] - center) @ precision @ (x[i] - center))
            assert got[rows[i][0]].distance == pytest.approx(want, rel=.25, abs=.6), (key, i)
            if not .7 < want / quality.CUTOFF < 1.4:
                assert got[rows[i][0]].kept == (not got[rows[i][0]].base_failed and want <= quality.CUTOFF)
    assert 0 < sum(not x.kept and not x.base_failed for x in got.values()) < 100
    # Another partitioning gives the same numbers to the last bit.
    other = {x.doc_id: x for x in quality.judge(frame.repartition(7), ["doc_id", "distance", "pair"]).collect()}
    assert {k: (v.distance, v.kept) for k, v in other.items()} == {k: (v.distance, v.kept) for k, v in got.items()}
    few = frame.limit(20)
    assert {x.distance for x in quality.judge(few, ["doc_id"]).collect()} == {None}
    assert quality.judge(frame.limit(0), ["doc_id"]).count() == 0
    assert quality.keep_good(frame).columns == frame.columns


def test_long_white_space_is_counted():
    """Runs cut where the pattern divides them give as many tokens; runs of a million end."""
    tokens = token_counts.encoder(open(token_counts.RANKS, "rb").read())
    r = random.Random(4)
    spaces = " \n\t\r\x0b\x85\xa0\u2003\u3000"
    for _ in range(300):
        text = ""
        for _ in range(r.randrange(1, 6)):
            one = r.choice(spaces)
            text += "".join(one if r.random() < .9 else r.choice(spaces) for _ in range(int(r.paretovariate(.5)) % 2001))
            text += r.choice(["word", "'s", "7", "!?", "\x1c", "\u200b", "漢字", ""])
        want = len(tokens.encode_ordinary(text))
        assert token_counts.length(tokens, text, r.choice((2, 3, 10, 100))) == want == token_counts.length(tokens, text)
    assert token_counts.length(tokens, "a" + "\n" * 2_000_000 + "b") > 2
    assert token_counts.length(tokens, " " * 2_000_000) > 1


def test_token_counts(spark, docs_of, odd):
    tokens = token_counts.encoder(open(token_counts.RANKS, "rb").read())
    rows = odd + [(50, "<|endoftext|> is text")]
    lengths = [len(tokens.encode_ordinary(t or "")) for _, t in rows]
    docs = docs_of(rows)
    assert sorted(r[0] for r in token_counts.token_counts(docs, []).collect()) == sorted(lengths)
    for text in (rows[5][1], rows[50 - 50 + 12][1]):
        assert tokens.decode(tokens.encode_ordinary(text)) == text
    found = token_counts.token_report(docs).cache()
    assert found.count() == len(set(lengths))
    for r in found.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_to, r.docs_beyond) == (lengths.count(n), sum(x <= n for x in lengths),
                                                        sum(x > n for x in lengths))
        assert (r.tokens_to, r.tokens_beyond) == (sum(x for x in lengths if x <= n), sum(x for x in lengths if x > n))
        assert (r.truncated_total, r.lost) == (sum(min(x, n) for x in lengths), sum(max(0, x - n) for x in lengths))
    for limit in (0, 3, 1000, 10 ** 9):
        assert token_counts.truncated(found, limit).first()[0] == sum(min(x, limit) for x in lengths)
    assert token_counts.quantiles(found, (0.5,)).first()[0] == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert token_counts.token_report(docs, ["source"]).count() >= found.count()
    assert token_counts.token_report(docs_of([])).count() == 0


def test_revisits_of_odd_records(spark):
    at = "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {})"
    record = ("SELECT {} AS record_id, '{}' AS kind, {} AS uri, " + at + " AS at, {} AS status, {} AS headers, "
              "{} AS digest, 1 AS url, 'x' AS outcome")
    tag = "map('ETag', '\"1\"', 'Content-Length', '9')"
    rows = [record.format(*r) for r in (
        (1, "response", "'http://WWW.a.org:80/p/?b=2&a=1#x'", 0, 200, tag, "'d'"),
        (2, "revisit", "'https://a.org/p?a=1&b=2&utm_source=q'", 30, 304, "map('etag', 'W/\"1\"', 'Date', 'new', 'Set-Cookie', 'c')", "'d'"),
        (3, "revisit", "'a.org/p?a=1&b=2'", 0, 304, tag, "'d'"),
        (4, "response", "'a.org/p?a=1&b=2'", 40, 500, tag, "'e'"),
        (5, "revisit", "'a.org/p?a=1&b=2'", 50, 304, "map('etag', '\"2\"')", "'d'"),
        (6, "revisit", "'a.org/p?a=1&b=2'", 50, 304, "CAST(NULL AS map<string,string>)", "NULL"),
        (7, "revisit", "CAST(NULL AS string)", 50, 304, tag, "'d'"),
        (8, "request", "'a.org/p?a=1&b=2'", 20, 200, tag, "'d'"))]
    records = spark.sql(" UNION ALL ".join(rows))
    found = {r.record_id: r for r in revisits.resolve(records, division=1).collect()}
    assert {k: r.outcome for k, r in found.items()} == {2: "resolved", 3: "missing", 5: "changed", 6: "unchecked",
                                                        7: "unplaced"}
    assert found[2].response_id == 1
    assert found[2].headers == {"etag": 'W/"1"', "content-length": "9", "date": "new"}
    assert revisits.resolve(records.where("false")).count() == 0
    alike = revisits.resolve(records, division=10 ** 6)
    assert {(r.record_id, r.outcome, r.response_id) for r in alike.collect()} \
        == {(k, r.outcome, r.response_id) for k, r in found.items()}


def test_fuzzy_lines(docs_of, odd):
    """Groups by the edit distance of all pairs of lines, whatever blocks they share."""
    r = random.Random(3)
    base = [" ".join(f"word{r.randrange(10 ** 6)}" for _ in range(40)) for _ in range(12)]
    near = [b.replace(b.split()[k], "Changed") for k, b in enumerate(base)]
    rows = odd + [(100 + i, f"{x}\n\n  {x.upper()}\t\nunique {i}") for i, x in enumerate(base)]
    rows += [(200 + i, f"head {i}\n{x}") for i, x in enumerate(near)]
    got = {x.doc_id: x for x in fuzzy_lines.fuzzy_lines(docs_of(rows), ["doc_id"]).collect() if x.doc_id}
    lines = sorted({y for _, t in rows for x in (t or "").split("\n") if (y := x.lower().strip(" \t\r\x0b\x0c")) and len(y) < 2000})
    union = brute.Union()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) * 10 <= max(len(a), len(b)) and brute.edit(a, b) <= max(len(a), len(b)) // 10:
                union.join(a, b)
    seen, want = set(), {}
    for doc, text in sorted((x for x in rows if x[0] is not None and x[0] >= 100), key=lambda x: x[0]):
        gone = []
        for k, line in enumerate(text.split("\n")):
            if line := line.lower().strip(" \t\r\x0b\x0c"):
                root = union.find(line)
                gone += [k] * (root in seen)
                seen.add(root)
        want[doc] = gone
    assert {k: x.removed for k, x in got.items() if k >= 100} == want
    assert all(2 in want[100 + i] and 1 in want[200 + i] for i in range(12))
    assert got[1].n_lines == got[2].n_lines == got[3].n_lines == got[11].n_lines == 0
    assert fuzzy_lines.fuzzy_lines(docs_of([]), ["doc_id"]).count() == 0


def test_lines_are_taken_out_by_row(docs_of, odd):
    """Ids that repeat or are missing multiply no rows and cost other rows no lines."""
    same = "a line that is long enough to count as one of those that documents have in common"
    rows = [(1, f"{same}\nfirst"), (1, f"other\n{same}"), (None, f"{same}!\nthird"), (None, "fourth\nmore"), *odd]
    kept = fuzzy_lines.without_lines(docs_of(rows))
    assert kept.columns == docs_of(rows).columns and kept.count() == len(rows)
    texts = [x.text for x in kept.collect()]
    assert sum(same in (t or "") for t in texts) == 1  # the first by id, then by hash
    assert all(sum(x in (t or "").split("\n") for t in texts) == 1 for x in ("first", "other", "third", "fourth", "more"))
    assert texts.count(None) == 1 and texts.count("") >= 1


def edited(r, line, share, kind, word):
    """A copy of a line with words replaced, dropped, added or mistyped, for about a share of its letters."""
    words, done = line.split(" "), 0
    while done < max(1, int(share * len(line))):
        i = r.randrange(len(words))
        how = r.choice(("word", "typo", "drop", "add")) if kind == "mix" else kind
        if how == "word":
            new = word()
            done += max(len(words[i]), len(new))
            words[i] = new
        elif how == "typo":
            k = r.randrange(len(words[i]))
            words[i] = words[i][:k] + r.choice("xyzq") + words[i][k + 1:]
            done += 1
        elif how == "drop" and len(words) > 2:
            done += len(words.pop(i)) + 1
        else:
            words.insert(i, word())
            done += len(words[i]) + 1
    return " ".join(words)


def test_recall_of_fuzzy_lines(docs_of):
    """Pairs within the edit distance that are found, by length and by kind of edit."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghiklmnorstuvw") for _ in range(r.choice((2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 11))))
                  for _ in range(4000)]
    word = lambda: vocabulary[min(int(r.paretovariate(.7)), 3999)] if r.random() < .5 else r.choice(vocabulary)
    pairs = []
    for band, (low, high) in enumerate(((15, 40), (41, 80), (81, 200), (201, 1000), (5001, 6000))):
        for kind in ("word", "typo", "mix"):
            for k in range(60 if high < 5000 else 12):
                line, size = word(), r.randint(low, high)
                while len(line) < size:
                    line += " " + word()
                pairs.append((band, kind, line, edited(r, line, (.01, .03, .06, .09)[k % 4], kind, word)))
    rows = [(2 * i + side, p[2 + side]) for i, p in enumerate(pairs) for side in (0, 1)]
    lines, found = fuzzy_lines.groups(docs_of(rows))
    line, root = (dict(map(tuple, x)) for x in (lines.select("doc_id", "line_id").collect(), found.collect()))
    met = defaultdict(list)
    for i, (band, kind, a, b) in enumerate(pairs):
        if duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0] <= max(len(a), len(b)) // 10:
            x, y = line[2 * i], line[2 * i + 1]
            met[band, "typo" if kind == "typo" else "words"].append(root.get(x, x) == root.get(y, y))
    recall = {k: sum(v) / len(v) for k, v in met.items()}
    assert all(recall[band, "words"] >= .9 for band in range(5)), recall
    assert all(recall[band, "typo"] >= least for band, least in enumerate((.85, .9, .5, .4, .2))), sorted(recall.items())
    assert sum(map(sum, met.values())) >= .85 * sum(map(len, met.values())), sorted(recall.items())


def test_lines_of_crowded_blocks_find_each_other(docs_of):
    """All pairs of near lines that agree in enough blocks are in one group, whoever is between them in the blocks."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghiklmnorstuvw") for _ in range(r.randint(5, 9)))
    base, lines = [word() for _ in range(60)], []
    for _ in range(120):
        far = [word() if r.random() < .3 else w for w in base]
        lines += [" ".join(far), " ".join(w[:-1] + "z" if r.random() < .2 else w for w in far)]
    lines += ["tiny line 1", "tiny line 2", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "short", "shor"]
    frame = docs_of(list(enumerate(lines)))
    table, found = fuzzy_lines.groups(frame)
    line, root = (dict(map(tuple, x)) for x in (table.select("doc_id", "line_id").collect(), found.collect()))
    keys, held = defaultdict(set), fuzzy_lines.blocks_held
    for x in fuzzy_lines.simhashes(table).select("line_id", "key", F.expr(held("sign")).alias("held")).collect():
        keys[x.line_id, x.key & 1].add((x.key, x.held))
    near = 0
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            x, y = line[i], line[j]
            for turn in (0, 1):
                both, least = keys[x, turn], min([h for k in (x, y) for _, h in keys[k, turn]], default=0)
                agree = len({k for k, _ in both} & {k for k, _ in keys[y, turn]})
                if agree >= max(1, 3 if least >= 6 else min(2, least)) and brute.edit(a, b) <= max(len(a), len(b)) // 10:
                    near += 1
                    assert root.get(x, x) == root.get(y, y), (a, b)
    assert near >= 40


def test_letters_rule_out_no_near_line(spark):
    """The bound by characters holds at the edit distance itself, for lines of any length, and rules out others."""
    r = random.Random(7)
    lines, pairs = {}, []
    for k, size in enumerate([4, 10, 11, 30, 31, 60, 200, 199, 3000] * 12):
        line = "".join(r.choice("aaaeeiou bcdxyzäß漢😀") for _ in range(size))
        near = list(line)
        for _ in range(size // 10):
            i = r.randrange(len(near))
            near[i:i + 1] = r.choice(([], [r.choice("qjk")], [near[i], r.choice("qjk")]))
        near = "".join(near)
        far = "".join(r.choice("ghlmnp") for _ in range(size))
        lines |= {3 * k: line, 3 * k + 1: near, 3 * k + 2: far}
        pairs += [(3 * k, 3 * k + 1), (3 * k + 1, 3 * k), (3 * k, 3 * k + 2)]
    lines[-1], lines[-2] = "a" * 40_000, "a" * 39_000 + "b" * 1_000  # counts beyond what a lane holds
    pairs += [(-1, -2), (-2, -1)]
    rows = [(k, x) for k, x in lines.items()] * 2  # a line read in two equal documents counts once
    told = fuzzy_lines.letters(spark.createDataFrame(rows, "line_id long, line string")).cache()
    assert {x.line_id: x.size for x in told.collect()} == {k: len(x) for k, x in lines.items()}
    left = {tuple(x) for x in fuzzy_lines.with_near_letters(spark.createDataFrame(pairs, "a long, b long"), told).collect()}
    assert {p for p in pairs if max(p) < 0 or p[0] // 3 == p[1] // 3 and 2 not in (p[0] % 3, p[1] % 3)} <= left
    assert not any(len(lines[a]) >= 10 and b >= 0 and b % 3 == 2 for a, b in left)


def test_lines_that_share_blocks_by_chance_are_no_pairs(docs_of, monkeypatch):
    """Lines that agree in enough blocks but can't be near are ruled out before their texts are read; crowded blocks
    and others find the same groups."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghiklmnorstuvw") for _ in range(8))
    common, rows = [word() for _ in range(9)], []
    for _ in range(60):
        line = common + [word() for _ in range(9)]
        rows += [" ".join(line), " ".join([*line[:-1], line[-1][:-1] + "z"])]
    rows = list(enumerate(rows))
    asked, real = [], fuzzy_lines.verified
    monkeypatch.setattr(fuzzy_lines, "verified", lambda docs, lines, pairs: asked.append(pairs.count()) or real(docs, lines, pairs))
    found = []
    for crowd in (fuzzy_lines.CROWD, 2):
        monkeypatch.setattr(fuzzy_lines, "CROWD", crowd)
        lines, roots = fuzzy_lines.groups(docs_of(rows))
        line, root = (dict(map(tuple, x)) for x in (lines.select("doc_id", "line_id").collect(), roots.collect()))
        found.append({i: root.get(x, x) for i, x in line.items()})
        assert all(found[-1][2 * i] == found[-1][2 * i + 1] for i in range(60))
    assert found[0] == found[1] and len(set(found[0].values())) == 60
    assert max(asked) <= 300


def test_shuffles_of_a_written_table_go(spark, tmp_path):
    """The setting by which shuffle files go holds while a table is written, and only then."""
    before = spark.conf.get(shared.SHUFFLES_GO, "false")
    with shared.scratch():
        assert shared.cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert spark.conf.get(shared.SHUFFLES_GO, "false") == before


def test_a_block_is_the_majority_of_its_features(spark):
    """Blocks that an edit leaves alone stay the same; its features' own blocks are counted by hand."""
    words = [f"feature{i}" for i in range(30)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1] + ["another"]))], "doc_id long, text string")
    lines = fuzzy_lines.line_table(frame).collect()
    assert all(x.band == lines[0].band for x in lines)
    keys = defaultdict(set)
    for x in fuzzy_lines.simhashes(fuzzy_lines.line_table(frame)).collect():
        keys[x.line_id].add(x.key)
    a, b = keys.values()
    assert 3 <= len(a) <= 2 * fuzzy_lines.BLOCKS and len(a ^ b) <= 8 and len(a & b) >= len(a) - 4


CLASHING = ["doc_id", "n", "n1", "id1", "id2", "t1", "t2", "n_words", "places", "spans", "n_tokens", "row", "node", "windows",
            "n_lines", "distance", "key", "x0", "n_shingles", "kept_text", "items", "text"]


@pytest.mark.parametrize("name", ["decontaminate", "repeats", "private", "tokens", "near", "quality", "lines"])
def test_kept_columns_of_any_name(spark, odd, name):
    """Columns named as an operator's own come through; those named as its results give way."""
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(
        f"{c} string" for c in CLASHING if c not in ("doc_id", "text"))
    docs = spark.createDataFrame([(i, t, "en", "a", *[f"{c}!" for c in CLASHING if c not in ("doc_id", "text")]) for i, t in odd], schema)
    items = spark.createDataFrame([(1, "one"), (2, "a b c d")], "item_id long, text string")
    call, results = {
        "decontaminate": (lambda: contamination.decontaminate(docs, items, CLASHING), contamination.RESULT),
        "repeats": (lambda: repeats.remove_repeats(docs, CLASHING), ("n_words", "n_removed", "kept_text")),
        "private": (lambda: private.private_spans(docs, CLASHING), ("spans",)),
        "tokens": (lambda: token_counts.token_counts(docs, CLASHING), ("n_tokens",)),
        "near": (lambda: near_duplicates.near_duplicates(docs, CLASHING), ("n_shingles", "component_id")),
        "quality": (lambda: quality.judge(docs, CLASHING), quality.RESULT),
        "lines": (lambda: fuzzy_lines.fuzzy_lines(docs, CLASHING), fuzzy_lines.RESULT)}[name]
    found = call()
    kept = [c for c in CLASHING if c not in results]
    assert found.columns == [*kept, *results]
    rows = found.collect()
    assert len(rows) == len(odd)
    assert sorted((repr(r.doc_id), repr(r.text)) for r in rows) == sorted((repr(i), repr(t)) for i, t in odd)
    assert all(r[c] == f"{c}!" for r in rows for c in kept if c not in ("doc_id", "text"))


def test_tables_of_a_run_go_at_its_end(spark, docs_of, odd, tmp_path):
    """What operators write between their steps is gone once the result has been taken."""
    folder = shared.shared_folder(spark)
    left = lambda: {f for f in os.listdir(folder) if f.startswith("corpus-")}
    before = left()
    with shared.scratch():
        assert near_duplicates.near_duplicates(docs_of(odd), ["doc_id"]).count() == len(odd)
        assert left() > before
    assert left() == before
