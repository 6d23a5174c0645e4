"""Chat, token counts, neighbours, near-duplicates, decontamination, toxicity and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import ann, chat, decontam, minhash, queries, tokencount, toxicity

TINY = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def pd_array(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], SCHEMA)


def test_chat_round_trip(spark):
    said = ["", None, "plain", r"\### Assistant: </turn> ok", r"\\</turn>\<says><turn></turn></turn>", "<tu</turn>rn>", "a\\", "é😀" * 9, "x" * 70_000]
    rows = [(c, t, r, s) for c in (1, 2, None) for t, (r, s) in enumerate([(r, s) for r in ("user", "assistant", "<turn>", None) for s in said])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    formatted = chat.format_conversations(df)
    back = {(r.conv_id, r.turn): r for r in chat.read_back(formatted).collect()}
    assert len(back) == len(rows)
    for c, t, r, s in rows:
        got = back[c, t]
        assert (got.role, got.text, got.loss) == (r or "", s or "", (s or "") if r == "assistant" else "")
    by = {r.conv_id: r for r in chat.digests(chat.read_back(formatted)).collect()}
    mine = sorted((t, r or "", s or "") for c, t, r, s in rows if c == 1)
    assert by[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{s}\n" for _, r, s in mine).encode()).hexdigest()
    loss = "".join(s for _, r, s in mine if r == "assistant")
    assert by[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and by[1].loss_chars == len(loss) and set(by) == {1, 2, None}
    assert chat.digests(chat.read_back(chat.format_conversations(df.limit(0)))).count() == 0


def test_chat_query(spark):
    turns = pd.read_parquet(f"{TINY}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op1_chat(spark, TINY).collect()}
    for c, g in turns.groupby("conv_id"):
        g = g.sort_values("turn")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for r, t in zip(g.role, g.text)).encode()).hexdigest()
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(r"\### Assistant: </turn> ok") and len(got) == turns.conv_id.nunique() + 1


def test_long_texts_are_cut_where_tokens_end():
    rnd = random.Random(3)
    model, parts = chat.encoder(), ["word", " word", "  ", "\n", " 12", "'s", " 's", "é", " !?", "\t", "x" * 300, " ", "日本 語"]
    for _ in range(6):
        text = "".join(rnd.choice(parts) for _ in range(30_000))
        assert "".join(chat.segments(text)) == text and max(map(len, chat.segments(text))) <= chat.SEGMENT
        assert chat.encode(text, model) == model.encode_ordinary(text)
    for text in (" " * 200_000, "y" * 100_000, " \n" * 60_000, "a  b" * 30_000):
        assert model.decode(chat.encode(text, model)) == text


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokencount.model_path(None))
    texts = [None, "", " ", "   a  b ", "\n\n x\ty\r\n", "▁already▁marked", "<s> </s> <unk> <0x0A>", "日本語😀 é\u0000", "word " * 3000, "z" * 5000, "!!!???...", "  \n  \n", "a\u00a0b\u2003c"]
    texts += pd.read_parquet(f"{TINY}/documents.parquet").text.tolist()
    got = {r.doc_id: r for r in tokencount.count_tokens(table(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((t or "").encode()), want > 4096), (i, t)
    assert tokencount.count_tokens(table(spark, [])).count() == 0


def brute(rows, ids, k):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None}
    out = {}
    for q in ids:
        if q in good:
            near = sorted((float(np.sqrt(np.square(good[q] - v).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = near[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16) + 3 * (i % 5)]) for i in range(1200)]
    rows += [(5000 + i, rows[7][1]) for i in range(300)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] + [1.0] * 15), (9300, [None] + [1.0] * 15), (9400, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), block=500, query_block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows, [i for i, _ in rows if i is not None and i % 100 == 0], 10)
    assert set(got) == set(want)
    assert sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items()) >= 0.95 * sum(map(len, want.values()))
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 3
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_neighbours_query_recall(spark):
    rows = pd.read_parquet(f"{TINY}/embeddings.parquet")
    want = brute([(i, list(map(float, v))) for i, v in zip(rows.vec_id.tolist(), rows.embedding)], [i for i in rows.vec_id if i % 100 == 0], 10)
    got: dict = {}
    for r in queries.op9_collision_ann(spark, TINY).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    found = [(q, i, d) for q, w in want.items() for d, i in w if i in got[q]]
    assert len(found) >= 0.95 * sum(map(len, want.values())) and all(got[q][i] == pytest.approx(d, abs=1e-12) for q, i, d in found)


def words(t):
    return re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", (t or "").lower())


def true_classes(rows):
    """The smallest id of the component of each document; a shingle weighs as often as it occurs."""
    counts = {i: Counter(zip(*[w[k:] for k in range(5)]) if len(w) >= 5 else [tuple(w)] if w else []) for i, w in ((i, words(t)) for i, t in rows)}
    sets = {i: {(x, k) for x, n in c.items() for k in range(n)} for i, c in counts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by: dict = {}
    for i, s in sets.items():
        for x in s or ():
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for m in by.values() for a in m for b in m if a < b}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


def test_near_duplicates(spark):
    rnd = random.Random(8)
    rows = [(i, t) for i, t in zip(range(200), pd.read_parquet(f"{TINY}/documents.parquet").text)]
    base = " ".join(f"word{rnd.randint(0, 999)}" for _ in range(300))
    for i in range(60):
        w = base.split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(300)] = f"edit{rnd.randint(0, 99)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, "the same short text") for i in range(20)] + [(3000, None), (3001, ""), (3002, ""), (3003, "one"), (3004, "ONE!"), (3005, "x " * 30_000)]
    got = {r.doc_id: r.class_id for r in minhash.classes(table(spark, rows)).collect()}
    assert got == true_classes(rows)
    twice = table(spark, rows[:3] + rows[:3] + [(None, "no id")])
    assert minhash.classes(twice).count() == 3
    assert minhash.classes(table(spark, [])).count() == 0
    assert minhash.one_of_each(table(spark, rows)).count() == len(set(got.values()))


def test_near_duplicates_of_odd_rows(spark):
    """Repeated rows, an id of several texts, rows without ids, clashing columns, ties of classes in two buckets."""
    rnd = random.Random(11)
    text = " ".join(f"w{rnd.randint(0, 500)}" for _ in range(120))
    rows = [(5, text), (5, text), (3, text + " more"), (9, "zz other words here"), (9, "an own text of this id"), (None, text), (None, text), (1, None), (1, None), (2, "")]
    docs = table(spark, rows).withColumns({"id": F.lit(0), "label": F.lit("x"), "key": F.lit(1), "words": F.lit(2)})
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == {5: 3, 3: 3, 9: 9, 1: 1, 2: 2}
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == sorted([(3, text + " more"), (9, "an own text of this id"), (0, text), (0, text), (1, ""), (2, "")])
    # a chain: each like the next, the ends unlike
    words_, chain = [f"c{k}" for k in range(200)], []
    for i in range(12):
        chain.append((100 - i, " ".join(words_)))
        for k in rnd.sample(range(200), 3):
            words_[k] = f"n{i}x{k}"
    got = {r.doc_id: r.class_id for r in minhash.classes(table(spark, chain)).collect()}
    assert got == true_classes(chain) and len(set(got.values())) == 1
    repeated = [(i, " ".join(["same line again"] * (20 + i))) for i in range(8)] + [(50, "same line again " * 90)]
    assert {r.doc_id: r.class_id for r in minhash.classes(table(spark, repeated)).collect()} == true_classes(repeated)


def test_near_duplicates_of_a_full_bucket(spark):
    rnd = random.Random(5)
    base = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(60):  # a family just under the bound, all in one bucket
        w = list(base)
        for k in rnd.sample(range(300), 8):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    for i, j in ((20, 31), (41, 8), (55, 47)):
        rows[i] = (i, rows[j][1] + " more")
    signed = spark.createDataFrame([(i, [7]) for i, _ in rows], "id long, bands array<long>")
    got = {r.id: r.label for r in minhash.labels(signed, table(spark, rows)).collect()}
    want = true_classes(rows)
    assert len(set(want.values())) == 57 and got == want


def test_near_duplicates_take_few_exchanges(spark, monkeypatch):
    """Each exchange costs as many tasks as there are partitions; classes of few links take no rounds of them, those of many are the same."""
    rnd = random.Random(13)
    rows = []
    for f in range(6):
        words_ = [f"f{f}w{k}" for k in range(150)]
        for i in range(15):  # chains: each like the next
            rows.append((1000 - 100 * f - i, " ".join(words_)))
            for k in rnd.sample(range(150), 2):
                words_[k] = f"n{f}x{i}x{k}"
    want, context = true_classes(rows), spark.sparkContext
    jobs = {}
    for few in (minhash.FEW, 0):
        monkeypatch.setattr(minhash, "FEW", few)
        context.setJobGroup(f"classes, {few}", "")
        assert {r.doc_id: r.class_id for r in minhash.classes(table(spark, rows)).collect()} == want
        jobs[few] = len(context.statusTracker().getJobIdsForGroup(f"classes, {few}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[max(jobs)] <= 70 < jobs[0]


def test_links_joined_by_the_driver():
    rnd = random.Random(17)
    a, b = (np.array([rnd.randrange(-500, 500) for _ in range(400)]) for _ in range(2))
    root = {x: x for x in (*a.tolist(), *b.tolist())}
    for _ in root:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            root[x] = root[y] = min(root[x], root[y])
    ids, found = minhash._joined(a, b)
    assert dict(zip(ids.tolist(), found.tolist(), strict=True)) == root
    assert [len(x) for x in minhash._joined(a[:0], b[:0])] == [0, 0]


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 1 << 62, (2, 400), dtype=np.uint64)
    both, wa, wb = a[:250], rng.uniform(0.2, 5, 400), rng.uniform(0.2, 5, 400)
    sa, sb = np.concatenate([both, a[250:]]), np.concatenate([both, b[250:]])
    names = minhash.darts(np.concatenate([sa, sb]), np.repeat([0, 1], 400), np.concatenate([wa, wb]), 3, 2048)
    true = np.minimum(wa[:250], wb[:250]).sum() / (np.maximum(wa[:250], wb[:250]).sum() + wa[250:].sum() + wb[250:].sum())
    assert abs((names[0] == names[1]).mean() - true) < 0.04 and (names[:2] > 0).all() and (names[2] == 0).all()


def test_decontamination(spark):
    rnd = random.Random(9)
    common = "the of and to in a is that it for".split()
    make = lambda n, tag: [rnd.choice(common) if rnd.random() < 0.4 else f"{tag}{rnd.randint(0, 4000)}" for _ in range(n)]
    items = [make(rnd.randint(16, 60), "w") for _ in range(30)]
    rows, want = [], set()
    for d in range(300):
        own = make(rnd.randint(0, 400), "w")
        if d % 10 == 0:
            i = rnd.randrange(30)
            leak = list(items[i])
            for _ in range(len(leak) // 8):  # a paraphrase: an eighth of the words is another
                leak[rnd.randrange(len(leak))] = f"w{rnd.randint(0, 4000)}"
            at = rnd.randint(0, len(own))
            own[at:at] = leak
            want.add((d, i))
        rows.append((d, " ".join(own)))
    rows += [(900, None), (901, ""), (902, " ".join(items[0]).upper())]
    want.add((902, 0))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(77, ""), (78, None), (None, "x y")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contaminated(table(spark, rows), bench).collect()}
    assert got == want
    left = decontam.without_contaminated(table(spark, rows), bench)
    assert left.count() == len(rows) - len({d for d, _ in want})
    assert decontam.find_contaminated(table(spark, []), bench).count() == 0 and decontam.find_contaminated(table(spark, rows), bench.limit(0)).count() == 0


def contaminated(spark, items, rows):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.find_contaminated(table(spark, rows), bench).collect()}


def test_decontamination_of_frequent_words(spark):
    rnd = random.Random(4)
    often = [f"often{k}" for k in range(40)]
    text = lambda n: [rnd.choice(often) if rnd.random() < 0.6 else f"w{rnd.randint(0, 4000)}" for _ in range(n)]
    frequent, leaked, other = " ".join(rnd.choice(often) for _ in range(30)), " ".join(f"leak{k}" for k in range(24)), " ".join(f"w{k}" for k in range(40))
    rows, want = [], set()
    for d in range(200):
        own, found = text(100), [i for i, every in ((0, 20), (1, 2)) if d % every == 0]
        for i in found:
            own[50:50] = (frequent, leaked)[i].split()
        rows.append((d, " ".join(own)))
        want |= {(d, i) for i in found}
    assert contaminated(spark, [frequent, leaked, other], rows) == want


def test_decontamination_of_short_and_long_items(spark):
    rnd = random.Random(6)
    text = lambda n: [f"w{rnd.randint(0, 900)}" for _ in range(n)]
    items = [text(4), text(400), text(250), *(text(40) for _ in range(40)), ["single"], text(2)]
    rows, want = [], set()
    for d in range(60):
        own, i = text(150), (0, 1, 2, 43, 44)[d % 5]
        if d % 2:
            own[70:70] = items[i]
            want.add((d, i))
        rows.append((d, " ".join(own)))
    got = contaminated(spark, [" ".join(t) for t in items], rows)
    assert {(d, i) for d, i in got if i < 3 or i == 43} == {(d, i) for d, i in want if i != 44} and got >= want


def test_decontamination_of_odd_rows(spark):
    """Repeated item ids, rows without ids, repeated rows, very long texts, clashing columns, hot items, empty tables."""
    rnd = random.Random(9)
    text = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    first, second, hot = text(30), text(25), text(20)
    put = lambda item, n: " ".join(text(n // 2) + item + text(n // 2))
    rows = [(1, put(first, 80)), (2, put(second, 40_000)), (2, put(second, 40)), (None, put(first, 50)), (None, " ".join(text(50))), (4, None), (5, ""), (5, put([], 90)), (5, put([], 90))]
    rows += [(100 + i, put(hot if i % 3 == 0 else [], 200)) for i in range(90)]
    docs = table(spark, rows).withColumns({"item_id": F.lit(1), "terms": F.lit("x"), "cosine": F.lit(2)})
    bench = spark.createDataFrame([(7, " ".join(first)), (7, " ".join(second)), (8, " ".join(hot)), (None, "w1 w2 w3"), (9, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contaminated(docs, bench).collect()}
    assert got == {(1, 7), (2, 7), (None, 7)} | {(100 + i, 8) for i in range(0, 90, 3)}
    kept = decontam.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted([0, 4, 5, 5, 5] + [100 + i for i in range(90) if i % 3])
    assert decontam.find_contaminated(docs.limit(0), bench).count() == 0 and decontam.find_contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.without_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_latent_space_against_a_dense_decomposition(spark):
    """The projection on the space of the randomised decomposition is as good as that of the exact one."""
    rnd = random.Random(2)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(6)]
    texts = [" ".join(rnd.choice(topics[i % 6]) for _ in range(160)) for i in range(60)]
    items = decontam.Items([0], [" ".join(w for t in topics for w in t)])
    terms, size = [items.terms_of(pd_array([t]))[0] for t in texts], len(items.vocabulary)
    rows, idf = [], np.random.default_rng(0).uniform(0.5, 2, size).astype(np.float32)
    for t in terms:
        for a in range(0, len(t), decontam.STRIDE):
            v = np.zeros(size)
            np.add.at(v, t[a : a + decontam.WINDOW], idf[t[a : a + decontam.WINDOW]])
            rows.append(v / np.linalg.norm(idf[t[a : a + decontam.WINDOW]]))
    dense = np.array(rows)
    frame = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(terms)], "doc_id long, terms binary").repartition(7)
    space = decontam.latent_space(frame, idf, np.zeros((1, size)), 0, rank=6).astype(float)
    exact = np.linalg.svd(dense, full_matrices=False)[2][:6].T
    lost = lambda v: np.linalg.norm(dense - dense @ v @ v.T)
    assert np.allclose(space.T @ space, np.eye(6), atol=1e-4) and lost(space) < 1.02 * lost(exact)


def test_decontamination_query(spark):
    docs, bench = (pd.read_parquet(f"{TINY}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r for r in queries.op3_latent_decontam(spark, TINY).collect()}
    whole = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, s in zip(bench.item_id, bench.text) if s in t}
    words = lambda t: re.findall(r"\w+", t.lower())
    items = {i: words(t) for i, t in zip(bench.item_id, bench.text)}
    # brute force: of every document and item, the longest common subsequence within stretches little longer than the item
    def best(own, text):
        wide, most = int(np.ceil(decontam.STRETCH * len(own))), 0
        vocabulary = set(own)
        for a in range(0, max(1, len(text) - len(own) + 1)):
            part = text[a : a + wide]
            if sum(w in vocabulary for w in part) < 0.5 * len(own):
                continue
            masks: dict = {}
            for p, t in enumerate(own):
                masks[t] = masks.get(t, 0) | 1 << p
            full = s = (1 << len(own)) - 1
            for t in part:
                u = s & masks.get(t, 0)
                s = ((s + u) | (s - u)) & full
            most = max(most, len(own) - s.bit_count())
        return most / len(own)

    found = {(d, i): best(own, words(t)) for d, t in zip(docs.doc_id, docs.text) for i, own in items.items()}
    sure = {k for k, v in found.items() if v >= 0.85}
    assert whole <= sure <= set(got) and all(found[k] >= decontam.PARAPHRASE - 1e-9 for k in got)


@pytest.fixture(scope="module")
def trained(spark):
    rnd = random.Random(3)
    clean = [f"clean{i}" for i in range(120)]
    make = lambda bad: " ".join(rnd.choice(["idiot", "scumbag", "trashy"]) if bad and rnd.random() < 0.08 else rnd.choice(clean) for _ in range(rnd.randint(30, 200)))
    rows = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(500)]
    docs = table(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, rows, toxicity.fit(docs, labels)


def test_toxicity(spark, trained):
    docs, labels, rows, net = trained
    held = {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i in held]
    assert len(right) > 60 and sum(right) >= 0.95 * len(right)
    odd = table(spark, [(1, None), (2, ""), (3, "clean1 " * 20_000), (3, "!!!")])
    scores = toxicity.score(odd.withColumns({"score": F.lit(1), "c0": F.lit("x")}), net).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(docs.limit(0), net).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) == 0


def slow_score(net, text):
    """One text at a time, one window at a time, one word at a time."""
    import numpy as np
    import pyarrow as pa

    from sparkloom.llm.words import words_of

    w, size = {k: v.astype(float) for k, v in net.w.items()}, toxicity.HIDDEN
    words = words_of(pa.array([text]))
    bucket, grams, mask, index = toxicity.distinct(words)
    chars = lambda k: w["gram"][grams[k][mask[k]]].mean(0) if mask[k].any() else np.zeros(toxicity.PART)
    gates = [np.concatenate([w["word"][bucket[k]], chars(k)]) @ w["in"] + w["bias"] for k in index]
    spans, at = [], 0
    while True:
        spans.append(range(at, min(at + toxicity.WINDOW, len(gates))))
        if at + toxicity.WINDOW >= len(gates):
            break
        at = min(at + toxicity.STRIDE, len(gates) - toxicity.WINDOW)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    logits = []
    for span in spans:
        states = np.zeros((len(span), 2 * size))
        for way, order in enumerate((list(span), list(span)[::-1])):
            h = np.zeros(size)
            for i in order:
                g, a = gates[i][way * 3 * size : (way + 1) * 3 * size], h @ w["back"][way]
                z, r = sigmoid(g[:size] + a[:size]), sigmoid(g[size : 2 * size] + a[size : 2 * size])
                new = np.tanh(g[2 * size :] + r * (a[2 * size :] + w["new"][way][0]))
                h = z * h + (1 - z) * new
                states[i - span[0], way * size : (way + 1) * size] = h
        looks = np.tanh(states @ w["look"] + w["tilt"]) @ w["see"] if len(span) else np.zeros(0)
        share = np.exp(looks - looks.max()) / np.exp(looks - looks.max()).sum() if len(span) else looks
        logits.append(share @ states @ w["out"] + w["base"][0])
    return sigmoid(np.log(np.exp(logits).sum()) - toxicity.SPREAD * np.log(len(logits)))


def test_toxicity_against_a_plain_pass(spark, trained):
    docs, _, rows, net = trained
    texts = [(i, t) for i, t, _ in rows[:25]] + [(900, ""), (901, "idiot"), (902, "Ärger über ÉCOLE " * 40), (903, " ".join(f"clean{k % 120}" for k in range(64))), (904, " ".join(f"clean{k % 120}" for k in range(65)))]
    got = {r.doc_id: r.score for r in toxicity.score(table(spark, texts), net).collect()}
    for i, t in texts:
        assert got[i] == pytest.approx(slow_score(net, t), abs=1e-4), i


def test_toxicity_query(spark):
    out = queries.op6_toxicity(spark, TINY).collect()
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{TINY}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(texts)
    for r in out:
        assert r.score == pytest.approx(slow_score(net, texts[r.doc_id] or ""), abs=1e-4) and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_gradients():
    """Against finite differences."""
    import pyarrow as pa

    from sparkloom.llm.words import words_of

    net = toxicity.Network.fresh(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    parts = words_of(pa.array(["one two three four", "five one"]))
    word, grams, mask, index = toxicity.distinct(parts)
    at = np.array([[index[0], index[1], index[2], index[3]], [index[4], index[5], len(word), len(word)]])
    live = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)
    labels, text = np.array([1.0, 0.0]), np.array([0, 1])

    def loss():
        x, _ = net.embed(word, grams, mask)
        gates = np.concatenate([x @ net.w["in"] + net.w["bias"], np.zeros((1, 6 * toxicity.HIDDEN))])
        z = toxicity.pooled_logits(net.run(gates, at, live)[0], text, 2)[0]
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    grads = net.gradients(word, grams, mask, at, live, text, labels)
    for name, cell in (("out", (3,)), ("see", (1,)), ("look", (2, 3)), ("back", (0, 1, 2)), ("back", (1, 2, 20)), ("new", (1, 0, 2)), ("in", (1, 5)), ("in", (8, 40)), ("bias", (3,)), ("word", (word[0], 1)), ("gram", (grams[0][0], 2)), ("base", (0,))):
        was = net.w[name][cell]
        net.w[name][cell] = was + 1e-3
        up = loss()
        net.w[name][cell] = was - 1e-3
        down = loss()
        net.w[name][cell] = was
        assert grads[name][cell] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-5), name


def test_pipeline(spark):
    docs = pd.read_parquet(f"{TINY}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    frame = spark.read.parquet(f"{TINY}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before = [(r.doc_id, r.text) for r in frame.collect()]
        after = corpus_pipeline.shared_table(stage(spark, frame, TINY), name)
        kept = {r.doc_id for r in after.collect()}
        assert after.columns == list(docs.columns)
        if name == "near_duplicates":
            assert kept == set(true_classes(before).values())
        if name == "decontamination":
            bench = pd.read_parquet(f"{TINY}/benchmark.parquet").text
            assert not any(s in t for i, t in before if i in kept for s in bench)
        frame = after
    out = corpus_pipeline.run(spark, TINY)
    assert set(docs.columns) < set(out.columns) and 0 < out.count() and out.where("shard not between 0 and 23").count() == 0
