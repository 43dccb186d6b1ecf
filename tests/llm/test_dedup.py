"""Exact, line and SimHash de-duplication against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from shoplens.llm.components import component_roots
from shoplens.llm.exact_dedup import QuotientFilter, block_bits, counting_filters, exact_dedup
from shoplens.llm.line_dedup import drop_shared_lines, line_dedup, shared_lines
from shoplens.llm.oracles import ORACLES
from shoplens.llm.simhash import SMALL_LIST, fingerprint_of, linked_within, near_links, one_of_each, simhash_components
from tests.llm.conftest import AWKWARD, LOWER, equals_sql, frame, words

SMALL = "/root/testdata/sf0.001"
COPIES = [(100 + i, "a text " + " " * (i % 5) + "with many copies", "en", "src0") for i in range(400)]


def norm(text):
    return "".join(words(text))


def test_exact_groups(spark, nothing):
    rows = AWKWARD + COPIES
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    expected = []
    for i, t, *_ in rows:
        keep = min(groups[norm(t)])[3]
        expected.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    found = exact_dedup(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert exact_dedup(nothing).count() == 0


@pytest.mark.parametrize("query, operator", [("op3_exact_dedup", exact_dedup), ("op8_line_dedup", line_dedup)])
def test_equals_sql(spark, query, operator):
    equals_sql(operator(spark.read.parquet(f"{SMALL}/documents.parquet")), ORACLES[query], documents=SMALL)


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 2**64, 500, np.uint64) for _ in range(3)]
    parts[1][:200] = parts[0][:200]
    parts[2][:50] = parts[0][0]
    filters = [QuotientFilter.of(p, 12) for p in parts]
    merged = filters[0].merged(*filters[1:])
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist())) == Counter(np.concatenate(parts).tolist())
    blocks = list(merged.blocks(64))
    assert np.array_equal(np.concatenate([b.fingerprints() for _, b in blocks]), merged.fingerprints())


def test_counts_over_partitions(spark):
    values = [5, -7, 5, 1 << 62, -(1 << 63), 5, -7, 0]
    df = spark.createDataFrame([(v,) for v in values], "f long").repartition(4)
    found = Counter()
    for row in counting_filters(df, len(values)).collect():
        part = QuotientFilter(
            block_bits(len(values)) + 16,
            np.frombuffer(row["quotients"], np.uint64),
            np.frombuffer(row["runs"], np.int64),
            np.frombuffer(row["remainders"], np.uint64),
            np.frombuffer(row["counts"], np.int64),
        )
        found.update(dict(zip(part.fingerprints().view(np.int64).tolist(), part.counts.tolist())))
    assert found == Counter(values)


def kept_lines(rows, points=20, documents=3):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    result = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            ids = holders[key(line)]
            gone = len(key(line)) >= points and len(ids) >= documents and i != max(x for x in ids if x is not None)
            kept += [] if gone else [line]
        result.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(result, key=str)


def test_lines(spark, nothing):
    rows = AWKWARD + [(200 + i, f"own line number {i} of this document\nA passage that very many documents share\nx", "en", "src0") for i in range(300)]
    docs = frame(spark, rows)
    done = drop_shared_lines(docs, counts=("before", "dropped"))
    found = [(r["doc_id"], r["text"], r["before"], r["dropped"]) for r in done.collect()]
    assert sorted(found, key=str) == kept_lines(rows)
    assert drop_shared_lines(docs).columns == docs.columns
    digests = {(r["doc_id"], r["kept_sha256"], r["n_dropped"]) for r in line_dedup(docs).collect()}
    assert digests == {(i, hashlib.sha256(t.encode()).hexdigest(), d) for i, t, _, d in kept_lines(rows)}
    assert line_dedup(nothing).count() == 0


def test_rows_without_id_are_documents_of_their_own(spark):
    passage, other = "A passage that rows without an id share", "Another passage, which one id has as well"
    rows = [(None, f"own words of number {n}\n{passage}\n{other}", "en", "s") for n in range(40)] + [(1, other, "en", "s")]
    docs = frame(spark, rows)
    done = drop_shared_lines(docs, counts=("before", "dropped"))
    texts = Counter(r["text"] for r in done.collect())
    assert sum(passage in t for t in texts) == 1 and all(f"own words of number {n}" in "\n".join(texts) for n in range(40))
    assert [t for t in texts if other in t] == [other]
    assert sorted(r["dropped"] for r in done.collect()) == [0, 1] + [2] * 39
    # No group of losses holds more than the lines of one document.
    assert {len(r["lines"]) for r in shared_lines(docs, 20, 3, "doc_id", "text").collect()} == {1, 2}
    assert drop_shared_lines(docs).columns == docs.columns


def fingerprint(text):
    own = [w.translate(LOWER) for w in words(text)]
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    prints = [fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    first = {}
    for (i, *_), own in zip(rows, label):
        if i is not None:
            first[own] = min(first.get(own, i), i)
    return [(i, f"{p:016x}", first.get(own)) for (i, *_), p, own in zip(rows, prints, label)]


def near_copies():
    base = [f"w{i}" for i in range(300)]
    rows = []
    for n in range(60):
        text = base.copy()
        for place in range(n % 4):
            text[(n * 37 + place * 11) % 300] = f"new{n}"
        rows.append((500 + n, " ".join(text), "en", "src0"))
    return rows


def test_components(spark, nothing):
    rows = [r for r in AWKWARD if r[0] != 9 and r[0] != 10] + near_copies()
    found = simhash_components(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted(components(rows), key=str)
    assert simhash_components(nothing).count() == 0
    kept = one_of_each(frame(spark, rows))
    expected = {c for _, _, c in components(rows)}
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted(expected, key=str)
    assert kept.columns == frame(spark, rows).columns


def test_every_component_keeps_a_row(spark):
    """Components without any id, or with the same smallest id, stay apart; each keeps one row."""
    rows = [(i, f"{name} {name}s only here, nothing like the others", "en", "s") for name, i in [("ant", None), ("bee", None), ("cow", 7), ("dog", 7)]]
    rows += [rows[0], rows[2], rows[2], (8, rows[3][1], "en", "s")]
    assert len({p for _, p, _ in components(rows)}) == 4
    kept = one_of_each(frame(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in kept], key=str) == sorted([r[:2] for r in rows[:4]], key=str)
    unlike = [(None, " ".join(f"t{n}w{k}" for k in range(20)), "en", "s") for n in range(50)]
    assert one_of_each(frame(spark, unlike)).count() == len(unlike)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"t{i % 71}" for i in range(1000))
    monkeypatch.setattr("shoplens.llm.simhash.SHINGLES_AT_ONCE", 64)
    assert fingerprint_of(text.encode()) == fingerprint(text)


@pytest.mark.parametrize("size", [2, 50, 128, 129, 600])
def test_links_within_a_list(size):
    """Short and long lists connect the same members as all pairs do."""
    rng = np.random.default_rng(size)
    members = np.unique(rng.integers(0, 1 << 16, size).astype(np.uint64) << np.uint64(8) | np.uint64(0xAB00000000000003))
    found = linked_within(members, 2, 0xFFFF00)
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= 2
    label = np.arange(len(members))
    for _ in range(len(members)):
        label = np.where(near, label[None, :], len(members)).min(axis=1)
    assert np.array_equal(found, label)


def test_every_pair_within_two_bits_is_connected(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40).tolist()
    values = {s ^ (1 << a) ^ (1 << b) for s in seeds for a in (0, 9, 33, 62) for b in (1, 9, 17, 63)} | set(seeds)
    values = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    links = near_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"))
    roots = {r["node"]: r["root"] for r in component_roots(links).collect()}
    raw = np.array(values, np.int64).view(np.uint64)
    for i, a in enumerate(raw):
        for j in np.flatnonzero(np.bitwise_count(a ^ raw[:i]) <= 2):
            assert roots[values[i]] == roots[values[j]]


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "a long, b long")
    roots = {r["node"]: r["root"] for r in component_roots(links).collect()}
    assert roots == {i: 0 for i in range(201)} | {400: 400, 500: 400}


@pytest.mark.parametrize("distance", [1, 2])
def test_long_lists_are_cut_without_losing_links(spark, distance):
    rng = np.random.default_rng(distance)
    # All share the bytes of four positions, so that their list is far longer than what is tallied in full.
    seeds = rng.integers(0, 1 << 32, 300, np.uint64)
    flips = np.array([[1 << int(b) for b in rng.integers(0, 32, 4)] for _ in seeds], np.uint64)
    values = np.unique(np.concatenate([seeds, *(np.bitwise_xor.reduce(flips[:, :k], axis=1) ^ seeds for k in range(1, 5))]))
    assert len(values) > 4 * SMALL_LIST
    links = near_links(spark.createDataFrame([(v,) for v in values.tolist()], "fingerprint long"), distance).collect()
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    place = {v: i for i, v in enumerate(values.tolist())}

    def labels(step):
        known = np.arange(len(values))
        while not np.array_equal(lower := step(known), known):
            known = lower
        return known

    def along_links(known):
        lower = known.copy()
        for a, b in links:
            lower[place[a]] = lower[place[b]] = min(lower[place[a]], lower[place[b]])
        return lower

    expected = labels(lambda known: np.where(near, known[None, :], len(values)).min(axis=1))
    assert np.array_equal(labels(along_links), expected)
