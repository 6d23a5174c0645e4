"""Sharding, personal data, mixing and line chunks against plain Python."""

import hashlib
import re
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import linededup, mixing, pii, queries, shard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, t, s in rows], SCHEMA)


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark):
    rows = [(i, f"text {i} é" if i % 3 else None, "src1") for i in range(500)] + [(7, "again", "src1"), (7, "again", "src1"), (None, "", "src2")]
    out = shard.assign_slots(table(spark, rows), 24).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            key = xxhash.xxh64(struct.pack("<q", r.doc_id), seed=42).intdigest()
            assert (r.shard, r.grown_shard) == (jump(key, 24), jump(key, 25))
            assert r.grown_shard in (r.shard, 24)
    for s in range(24):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    by_id = {r.doc_id: r for r in out if r.doc_id != 7}
    assert by_id[1].text_crc32 == zlib.crc32("text 1 é".encode()) and by_id[1].size == len("text 1 é".encode()) + 8
    assert by_id[3].size == 8 and by_id[3].text_crc32 == 0
    assert shard.assign_slots(table(spark, []), 24).count() == 0


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


TEXTS = [
    None, "", "é😀 a@b.c_d@e.f x@y a@b.c.d.e@f.g", "a@b..c@d.e %@x.y @x.y a@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 255.0.00255.1 12.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1111 41111111111111112222 5 4111111111111111", "12 345 6 4111111111111111x4012888888881881", "4111 1111 1111 1111 1",
    "+1 (499) 555-6503 +12 3 +4912345678901234567 ++1 212 555 0100.", "call +1 (499) 555-6503, card 4111111111111111; mail me@x.org, ip 10.0.0.1",
    "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 and GB82 WEST 1234 5698 7654 33", "x" * 50000 + "@" + "y" * 3000, "1" * 60000, "1 " * 30000, "a@b.co " * 700, "." * 20000 + "@a.b",
]


def test_pii(spark):
    df = table(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])
    found = pii.find_pii(df)
    assert found.columns == df.columns + ["pii"]
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    for r in found.select("doc_id", pii.joined(base).alias("b"), pii.joined(F.col("pii")).alias("all")).collect():
        assert r.b == base_spans(TEXTS[r.doc_id] or ""), r.doc_id
    assert r.b is not None
    iban = found.where("doc_id = 10").select(pii.joined(F.col("pii")).alias("s")).first().s
    assert [TEXTS[10][int(a) : int(b)] for k, a, b in (x.split(":") for x in iban.split(",")) if k == "iban"] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
    scores = {s.kind: s.score for s in found.where("doc_id = 9").first().pii}
    assert scores["phone"] > pii.SCORES["phone"] and scores["card"] > pii.SCORES["card"]


def test_pii_query_on_the_tables(spark):
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").set_index("doc_id")
    rows = queries.op4_pii(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(base_spans(docs.text[r.doc_id]).encode()).hexdigest()


def water(budget, nodes):
    """nodes: [(capacity, weight, name)] -> {name: share}"""
    left, weight, full, out = budget, sum(w for _, w, _ in nodes), True, {}
    order = sorted(nodes, key=lambda x: (x[0] / x[1], x[2]))
    for i, (c, w, n) in enumerate(order):
        if c * sum(x[1] for x in order[i:]) <= left * w:
            out[n], left = c, left - c
        else:
            open_w = sum(x[1] for x in order[i:])
            return out | {n: left * w // open_w for _, w, n in order[i:]}
    return out


def test_mixing(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 40))) if i % 11 else None, f"src{min(rnd.randint(0, 9), 6)}") for i in range(600)]
    weights = {"domain": {"domain0": 9, "domain1": 2}}
    out = mixing.mix(table(spark, rows), 120, weights, 2, seed=5, slices=16).collect()
    leaf = {i: (f"domain{int(s[3:]) % 4}", s, len((t or "").split())) for i, t, s in rows}
    tokens: dict = {}
    for d, s, n in leaf.values():
        if n:
            tokens[d, s] = tokens.get((d, s), 0) + n
    budget = sum(tokens.values()) * 120 // 100
    doms = {d for d, _ in tokens}
    top = water(budget, [(2 * sum(n for (d, _), n in tokens.items() if d == x), weights["domain"].get(x, 1), x) for x in doms])
    copies: dict = {}
    for d in doms:
        for s, share in water(top[d], [(2 * n, 1, s) for (x, s), n in tokens.items() if x == d]).items():
            epochs, rest = divmod(share, tokens[d, s])
            own = sorted((hashlib.md5(f"5:{epochs}:{i}".encode()).hexdigest(), n, i) for i, (_, x, n) in leaf.items() if x == s and n)
            for _, n, i in own:
                rest -= n
                copies[i] = epochs + (rest >= 0)
    assert {r.doc_id: r.copies for r in out} == {i: c for i, c in copies.items() if c}
    assert mixing.mix(table(spark, []), 50, {}, 2).count() == 0
    assert mixing.mix(table(spark, [(1, None, None)]), 50, {}, 2).count() == 0


def chunk_lines(texts):
    """(doc, first, n, part) of every chunk, by the rule in plain Python; texts: doc -> text."""
    from collections import Counter

    hashed = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16) & ((1 << 30) - 1)
    split = {d: t.split("\n") for d, t in texts.items() if t}
    rolls = {d: [hashed(a) << 30 | hashed(b) for a, b in zip(x, x[1:])] for d, x in split.items()}
    long = {d: [len(x) >= 39 and len(x.split()) >= 20 for x in y] for d, y in split.items()}
    pair_times = Counter(r for x in rolls.values() for r in x)
    alone_times = Counter(hashed(x) for d, y in split.items() for x, m in zip(y, long[d]) if m)
    out = []
    for d, lines in split.items():
        pairs = [n if (n := pair_times[r]) > 1 else 0 for r in rolls[d]] + [0]
        first = None
        for i, x in enumerate(lines):
            before, after = pairs[i - 1] if i else 0, pairs[i + 1] if i + 1 < len(lines) else 0
            if not (pairs[i] or before or (long[d][i] and alone_times[hashed(x)] > 1)):
                continue
            first = i if first is None else first
            least = before == after == pairs[i] > 0 and rolls[d][i] < min(rolls[d][i - 1], rolls[d][i + 1])
            if not pairs[i] or long[d][i] or (i + 1 < len(lines) and long[d][i + 1]) or before > pairs[i] or after > pairs[i] or least:
                out.append((d, first + 1, i - first + 1, "\n".join(lines[first : i + 1])))
                first = None
    return out


def test_line_chunks(spark):
    import random

    rnd = random.Random(5)
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(9)) for i in range(12))
    long_line = " ".join(f"long{j}" for j in range(60))
    rows = []
    for i in range(60):
        lines = [f"own {i} {j} " + "x" * rnd.randint(0, 5) for j in range(rnd.randint(0, 12))]
        if i % 3 == 0:
            lines.insert(rnd.randint(0, len(lines)), passage)
        if i % 5 == 0:
            lines.insert(rnd.randint(0, len(lines)), long_line)
        rows.append((i, "\n".join(lines), "s"))
    rows += [(60, None, "s"), (61, "", "s"), (62, rows[5][1], "s"), (63, "one\n" * 300, "s"), (64, "a\n\n\nb", "s"), (65, "c\n\n\nd", "s")]
    seen, want = set(), {}
    for i, first, n, part in sorted(chunk_lines({i: t for i, t, _ in rows})):
        if part.strip():
            if part in seen:
                want.setdefault(i, []).append((first, n))
            seen.add(part)
    df = table(spark, rows)
    got = {r["__id"]: [tuple(c) for c in r.cuts] for r in linededup.removals(df).collect()}
    assert got == want and len(got) > 20
    texts = {r.doc_id: r.text for r in linededup.line_dedup(df).collect()}
    assert all(sum((t or "").count(f"p{k}w3 ") for t in texts.values()) == 1 for k in range(12)) and sum((t or "").count("long3 ") for t in texts.values()) == 1
    assert texts[1] == rows[1][1] and texts[60] is None and len(texts) == len(rows) and texts[64] == rows[64][1]
    for r in linededup.report(df).collect():
        assert r.n_lines == (rows[r.doc_id][1] or "").count("\n") + 1 and r.n_removed == sum(n for _, n in want.get(r.doc_id, []))
    assert linededup.report(table(spark, [])).count() == 0


@pytest.mark.parametrize("lines, words", [(2, 8), (3, 18), (4, 15), (6, 12), (10, 12), (1, 55)])
def test_repeated_passages_go_whole(spark, lines, words):
    """Passages of any number of lines, in two documents or more, one directly behind another too."""
    import random

    rnd = random.Random(lines)
    fresh = iter(range(10**9))
    line = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n))
    passages = ["\n".join(line(words) for _ in range(lines)) for _ in range(20)]
    rows = []
    for i in range(80):
        own = [line(rnd.randint(1, 12)) for _ in range(rnd.randint(1, 9))]
        at = rnd.randint(0, len(own))
        own[at:at] = [passages[i % 20], passages[(7 * i + 3) % 20]][: 1 + i % 2]
        rows.append((i, "\n".join(own), "s"))
    left = "\n".join(r.text for r in linededup.line_dedup(table(spark, rows)).collect()).split("\n")
    assert sorted(left) == sorted({x for _, t, _ in rows for x in t.split("\n")})


def test_line_chunks_of_equal_ids(spark):
    """No row loses a chunk that no other document keeps."""
    shared = "first shared line\nsecond shared line\nthird shared line"
    rows = [(1, f"a\n{shared}", "s"), (1, f"a\n{shared}", "s"), (2, f"{shared}\nkeep me", "s"), (None, f"keep\n{shared}", "s"), (None, "other\nkeep me too\nand me", "s"), (2, f"x\n{shared}", "s")]
    df = table(spark, rows).withColumns({"cuts": F.lit(1), "cut_chars": F.lit("x"), "chunks": F.lit(2), "i": F.lit(3)})
    out = linededup.line_dedup(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id or 0), r.text) for r in out.collect())
    assert got == sorted([(1, "a"), (1, "a"), (2, "keep me"), (0, f"keep\n{shared}"), (0, "other\nkeep me too\nand me"), (2, "x")])
    alone = table(spark, rows[:2])
    assert [r.text for r in linededup.line_dedup(alone).collect()] == [rows[0][1]] * 2
    assert linededup.report(df).count() == len(rows)


def test_mixing_of_odd_tables(spark):
    """Weights of nought, repeated rows, clashing columns, nulls."""
    rows = [(1, "a b c", "src1"), (1, "a b c", "src1"), (2, "d e", "src2"), (3, None, "src3"), (None, "f g h i", None), (4, "", "src1")]
    df = table(spark, rows).withColumns({"domain": F.lit("own"), "copies": F.lit(7), "__epoch_": F.lit(1)})
    every = mixing.mix(df, 200, {}, 2)
    assert sorted(((r.doc_id or 0), r.domain, r.n_tokens, r.copies) for r in every.collect()) == [(0, "", 4, 2), (1, "domain1", 3, 2), (1, "domain1", 3, 2), (2, "domain2", 2, 2)]
    assert every.columns.count("domain") == 1 and every.columns.count("copies") == 1
    again = mixing.repeated(df, 200, {}, 2)
    assert again.columns == df.columns and again.count() == 8 and {r.domain for r in again.collect()} == {"own"} and {r.copies for r in again.collect()} == {7}
    none = mixing.mix(df, 100, {"domain": {"domain1": 0, "": 0}}, 1).collect()
    assert {r.doc_id for r in none} == {2}
    assert mixing.mix(df, 100, {"domain": {"domain1": 0, "domain2": 0, "": 0}}, 1).count() == 0
