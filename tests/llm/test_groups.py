"""Operators on pairs, and the pipeline, against brute force."""

import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.parity import compare, connect
from winnow.llm import components, decontaminate, embeddings, hnsw, language, lines, queries, sentencepiece, simhash

FOLDER = "/root/testdata/sf0.001"


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_queries_match_their_sql(spark, name):
    assert compare(connect(FOLDER), queries.queries()[name](spark, FOLDER), queries.oracle_sql()[name]) == []


# --- components


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(80)]
    names = {i: i * 7919 % 1009 - 300 for i in range(600)}
    found = components.components(
        spark.createDataFrame([(names[a], names[b]) for a, b in links] + [(None, 1)], "a long, b long")
    ).collect()
    root = roots(600, links)
    smallest = {}
    for i in range(600):
        smallest[root[i]] = min(smallest.get(root[i], 10**9), names[i])
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert sorted((r.node, r.root) for r in found) == sorted((names[i], smallest[root[i]]) for i in ends)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    each = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum((2 * sum(h >> k & 1 for h in each) > len(each)) << k for k in range(64))


def test_fingerprints():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["ab", "cd", "É", "ef\tgh", "Q"], k=n)) for n in (0, 1, 2, 3, 4, 5, 6, 7, 50, 255, 256, 257, 258, 259, 700)]
    texts += [None, "", " \n\x0b"]
    assert [int(x) for x in simhash.fingerprint_values(texts)] == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("rows", [100, 40_000, 200_000, 10**6, 10**8])
def test_close_fingerprints_share_an_anchor(rows):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, np.uint64)
    near = [int(b) ^ sum(1 << int(p) for p in rng.choice(64, k, replace=False)) for b in base for k in range(1, 7)]
    fps = np.unique(np.concatenate([base, np.array([*near, 0, 1, 2**64 - 1], np.uint64)]))
    sizes = simhash.block_sizes(rows)
    assert sum(sizes) == 64 and all(s % 2 for s in sizes)
    index, anchor = simhash.replicas(fps, sizes, 4)
    member = np.zeros((len(fps), len(np.unique(anchor))), np.float32)
    member[index, np.unique(anchor, return_inverse=True)[1]] = 1
    close = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    assert ((member @ member.T > 0) | ~close).all()


def test_anchors_keep_few_rows():
    assert all(sum(sizes) == 64 and all(s % 2 for s in sizes) for sizes in simhash.LADDER)
    assert all(len(b) > len(a) for a, b in zip(simhash.LADDER, simhash.LADDER[1:]))
    for power in range(3, 12):
        assert simhash.anchor_rows(10**power, simhash.block_sizes(10**power)) <= 2000


def test_a_block_of_near_copies_stays_small():
    rng = np.random.default_rng(4)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 60_000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60_000).astype(np.uint64)))
    fps = np.unique(np.concatenate([fps, rng.integers(0, 2**63, simhash.BLOCK_ROWS - len(fps)).astype(np.uint64)]))
    tracemalloc.start()
    a, b = simhash.local_links(fps, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    links = [(i, j) for i in range(200) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4]
    root = roots(200, links)
    found = dict(zip(*simhash.local_links(fps[:200], 4)))
    assert [int(found.get(x, x)) for x in fps[:200]] == [int(fps[r]) for r in root]
    assert len(a) > 2000 and len(set(b.tolist())) == 1


@pytest.mark.parametrize("block", [simhash.BLOCK_ROWS, 8])
def test_simhash_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)  # 8: every anchor is cut into blocks
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=150)) for _ in range(40)]
    for t in texts[:12]:
        own = t.split()
        for _ in range(6):
            own[rng.randrange(150)] = rng.choice(words)
            texts.append(" ".join(own))
    texts += texts[:5] + ["", "", None, "a b"]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    prints = [fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(len(ids), links)
    smallest = {r: min(ids[i] for i in range(len(ids)) if root[i] == r) for r in set(root)}
    wanted = sorted((ids[i], f"{prints[i]:016x}", smallest[root[i]], smallest[root[i]] == ids[i]) for i in range(len(ids)))
    assert sorted(tuple(r)[:4] for r in simhash.simhash_groups(docs).collect()) == wanted


# --- lines


def near_lines():
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdef ", k=n)).strip() + "z" for n in [*range(14, 36), 63, 64, 65, 400]]
    made = []
    for line in base:
        made.append(line)
        for _ in range(5):
            p = rng.randrange(len(line))
            made.append(rng.choice([line[:p] + line[p + 1 :], line[:p] + "x" + line[p:], line[:p] + "é" + line[p + 1 :], line, f"  {line} "]))
    made += ["aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaa", "short", "short", "", ""]
    rng.shuffle(made)
    return [(i, "\n".join(made[6 * i : 6 * i + 6])) for i in range(-(-len(made) // 6))]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1])
def test_lines_against_all_pairs(spark, edits):
    made = near_lines()
    seen, wanted = [], {}
    for doc_id, text in made:
        left = []
        for line in text.split("\n"):
            own = line.strip(" ")
            takes_part = len(own) >= lines.MIN_CHARS
            if not takes_part or not any(abs(len(own) - len(e)) <= edits and distance(own, e) <= edits for e in seen):
                left.append(line)
            if takes_part:
                seen.append(own)
        wanted[doc_id] = "\n".join(left)
    docs = spark.createDataFrame([(i, t, 1) for i, t in made], "doc_id long, text string, line_counts int").repartition(3)
    found = lines.dedup_lines(docs, max_edits=edits)
    assert {r.doc_id: r.text for r in found.select("doc_id", "text").collect()} == wanted


def test_variants_are_those_without_one_character():
    whole, less = lines.variant_hashes("aab😀c")
    assert less[0] == less[1] == lines.variant_hashes("ab😀c")[0] and less[3] == lines.variant_hashes("aabc")[0]
    assert len({whole, *less.tolist()}) == 5


def test_edit_bound_is_checked(spark):
    with pytest.raises(ValueError):
        lines.dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"), max_edits=2)


# --- decontamination


def brute_hits(text, every):
    def split(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    words, hit, found = split(text), set(), set()
    for item_id, item in every:
        own = split(item)
        if item_id is None or not own:
            continue
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def test_hits_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices("a b c d é f1".split(), k=rng.choice([1, 2, 3, 5, 8, 9, 10, 11, 14, 25])))) for i in range(40)]
    items += [(None, "a"), (77, None), (78, "..."), (3, "z z z")]
    texts = [" ".join(rng.choices("A b c. d É f1 é".split(), k=rng.randint(0, 80))) for _ in range(60)]
    for _ in range(60):
        text = rng.choice(texts).split(" ")
        text[rng.randrange(len(text)) :] = (rng.choice(items)[1] or "").upper().split(" ")
        texts.append("-".join(text))
    texts += [None, "", texts[5]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int").repartition(3)
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        n, hit, names = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated) == (n, hit, names, len(names), hit > 0)


# --- embeddings


def vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    made = [
        (i, (centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.3])).astype(np.float32).tolist(), int(rng.integers(2)))
        for i in range(300)
    ]
    made += [(400, None, 1), (401, [], 1), (402, [0.0] * 8, 1), (403, [1.0, None] + [0.0] * 6, 1), (404, [float("nan")] * 8, 0)]
    made += [(405, [float("inf")] + [1.0] * 7, 0), (None, *made[0][1:]), (406, made[5][1], None), (407, [1.0, 2.0], 0), (408, [2.0, 4.0], 0)]
    made += [(7, *made[9][1:]), made[3], (600, [2 * x for x in made[20][1]], made[20][2])]
    return made + [(500 + k, *made[20][1:]) for k in range(30)]


def brute_vectors(made, limit=embeddings.MIN_COSINE):
    groups, links = {}, []
    for i, (vec_id, v, label) in enumerate(made):
        if vec_id is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups.setdefault((label, len(v)), []).append(i)
    for own in groups.values():
        unit = np.array([made[i][1] for i in own], float)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        links += [(own[a], own[b]) for a, b in zip(*np.nonzero(unit @ unit.T >= limit)) if a < b]
    root = roots(len(made), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(made))
    low = {r: min((made[i][0] for i in range(len(made)) if root[i] == r and made[i][0] is not None), default=None) for r in set(root)}
    return sorted(((made[i][0] if made[i][0] is not None else -1), int(n[i]), low[root[i]] if made[i][0] is not None else -1) for i in range(len(made)))


@pytest.mark.parametrize("shard, block, part", [(embeddings.SHARD_ROWS, embeddings.QUERY_ROWS, embeddings.PART_BYTES), (40, 33, 1000)])
def test_embedding_groups(spark, monkeypatch, shard, block, part):
    monkeypatch.setattr(embeddings, "PART_BYTES", part)
    made = vectors()
    table = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").repartition(3)
    table = table.withColumns({c: F.lit(0) for c in ("n_links", "cid", "component_id", "kept", "dim", "shard", "group", "n")})
    found = embeddings.embedding_groups(table, shard_rows=shard, query_rows=block, growth=0).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in found) == brute_vectors(made)
    assert embeddings.embedding_groups(table.where("false")).count() == 0


def test_vectors_are_sent_to_few_shards(spark):
    rows = [10**k for k in range(3, 9)]
    found = spark.createDataFrame([(n,) for n in rows], "n long").select("n", embeddings.shards(F.col("n")).alias("s")).collect()
    sent = {r.n: r.s for r in found}
    assert sent[1000] == 1 and all(sent[10 * n] <= 4 * sent[n] for n in rows[2:-1])
    assert all(n / sent[n] <= embeddings.MOST_SHARD_ROWS for n in rows)


def test_no_link_is_lost_beside_a_hot_cluster():
    """A cluster of copies that fills every beam, and pairs that it must not hide."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    hot = centre + rng.normal(size=(700, 16)) * 0.03
    pairs = rng.normal(size=(500, 16))
    unit = np.concatenate((hot, pairs, pairs + rng.normal(size=pairs.shape) * 0.03))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    graph, order = hnsw.build(unit, rng.random(len(unit)) * 0.999 + 0.0005)
    held = unit[order]
    own = np.arange(len(held))
    found = {(int(a), int(b)) for _, nodes, query in embeddings.search_shard(graph, held, held, own, 0.93) for a, b in zip(query, nodes)}
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(held @ held.T >= 0.93)) if a != b}
    assert found <= true and len(found) >= 0.999 * len(true)
    cold = {t for t in true if not any(order[i] < 700 for i in t)}
    assert len(found & cold) >= 0.995 * len(cold)


def test_audits_have_links_and_no_self_hits():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(300, 24))  # no two of them link
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    audits, own = embeddings._audits(unit, unit, np.arange(300), 0.93)
    assert np.allclose(np.linalg.norm(audits, axis=1), 1)
    made = own < 0
    assert ((audits[made] @ unit.T >= 0.93 - 1e-9).any(axis=1)).all() and made.sum() == embeddings.AUDITS
    assert (np.sort(own[~made]) >= 0).all() and len(set(own[~made])) == (~made).sum()


def test_graph_finds_nearly_all_neighbours():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(3000, 32))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    graph, order = hnsw.build(unit, rng.random(3000) * 0.999 + 0.0005)
    held = unit[order]
    ids, _ = graph.search(held[:200].astype(np.float32), 128)
    true = np.argsort(-(held[:200] @ held.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.9


# --- pipeline


def test_no_text_is_lost_where_rows_share_a_doc_id(spark, tmp_path):
    rng = random.Random(21)
    a, b, c, d = (" ".join(rng.choices([f"w{i}" for i in range(300)], k=200)) for _ in range(4))
    near = b + " more"
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, a), (5, a), (5, b), (7, near), (5, b), (None, a), (9, c), (9, d), (None, c), (11, f"{c} {passage} {d}"), (11, d + " x")]
    rows += [(9, f"{passage} q"), (None, f"q {passage}"), (None, "q"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] or -1, r[1] or "")
    found = sorted(map(tuple, corpus_pipeline.dedup_documents(spark, docs, "").collect()), key=key)
    gone = {(5, a), (7, near), (4, "")} | {(11, d + " x")}
    assert found == sorted((r for r in rows if r not in gone), key=key)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(map(tuple, corpus_pipeline.decontaminate_documents(spark, docs, str(tmp_path)).collect()), key=key)
    assert found == sorted((r for r in rows if passage not in (r[1] or "")), key=key)


def test_pipeline_against_its_parts(spark):
    """Each stage's brute-force version, applied to what the stages before it kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    accepted = {r.doc_id for r in language.language_report(docs).collect() if r.accepted}
    assert len(accepted) >= 0.95 * len(left)
    found = corpus_pipeline.run(spark, FOLDER).collect()
    # language: what the stage keeps (it learns as the report does)
    kept = {i: t for i, t in left.items() if i in accepted}
    # lines
    seen, texts = set(), {}
    near = {r.doc_id: r.text for r in lines.line_report(spark.createDataFrame(list(kept.items()), "doc_id long, text string")).collect()}
    for i in sorted(kept):
        own = []
        for line in kept[i].split("\n"):
            if len(line.strip(" ")) < lines.MIN_CHARS or line.strip(" ") not in seen:
                own.append(line)
            seen.add(line.strip(" "))
        if near[i] == kept[i] or near[i].strip(" "):
            texts[i] = near[i]
        assert set(near[i].split("\n")) <= set(own) | {""}
    # near duplicates
    ids = sorted(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    root = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    texts = {i: texts[i] for k, i in enumerate(ids) if root[k] == k}
    # benchmark
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not brute_hits(t, items)[1]}
    fst = sentencepiece.compiled(sentencepiece.read_model())
    assert {r.doc_id: r.ids for r in found} == {i: np.frombuffer(fst.encode(t), np.int32).tolist() for i, t in texts.items()}
    assert all(r.exact for r in found)


def test_piece_pairs_keep_to_their_own_limit(monkeypatch):
    data = sentencepiece.read_model()
    texts = ["the river runs past", "stone-houses, ÀÉ ö 😀", "x" * 60, "under a bridge\nwhere children wait", "", "a ▁ b"] * 2
    free = sentencepiece.Transducer(sentencepiece.parse_model(data))
    wanted = [free.encode(t) for t in texts]
    assert free.n_pairs == sum(map(len, free.pairs.values())) > 5
    monkeypatch.setattr(sentencepiece, "PAIR_ENTRIES", 5)
    monkeypatch.setattr(sentencepiece, "MEMO_ENTRIES", 1)
    tight = sentencepiece.Transducer(sentencepiece.parse_model(data))
    for text, ids in zip(texts, wanted):
        assert tight.encode(text) == ids
        assert tight.n_pairs == sum(map(len, tight.pairs.values())) <= 5
        assert tight.decode(np.frombuffer(ids, np.int32).tolist()) == text.replace("▁", " ")
