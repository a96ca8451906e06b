"""Each training-data operator against a brute-force version, and its edge cases."""

import base64
import collections
import functools
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from conftest import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from textmill.llm import byte_bpe, common, features, fingerprints, html_text, packing, pii, quality_knn, quality_rules, simhash, token_counts, toxicity
from textmill.llm.queries import BYTE_BPE, QUERIES, WORD_BPE
from textmill.llm.word_bpe import WordBpe

EDGES = [
    (1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "One", "x"), (5, "One", "y"), (5, "One", "y"), (None, "no id", None), (6, "word " * 4000, "z"),
    (7, "a" * 30000, None), (10, "one <|endoftext|> two <|startoftext|>", None), (8, "日本語 ünï Σς 🙂 İ", None), (9, "+1 (988) 555-2485 a@b.co 1.2.3.4 4111 1111 1111 1111", None),
]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@functools.lru_cache
def library(special=True):
    made = Tokenizer.from_file(WORD_BPE)
    if not special:
        made.encode_special_tokens = True
    return made


def word_ids(text, special=True):
    return library(special).encode(text, add_special_tokens=False).ids + [1]


# --- 1 packing


def check_packing(rows, source):
    """Gapless windows; each id of each document in exactly one piece."""
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(itertools.accumulate([0, *(n for _, n in pieces[:-1])]))
        assert sum(n for _, n in pieces) <= 2048
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc, text in source:
        ids = word_ids(text)
        for r in pieces[doc]:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
    copies = collections.Counter(d for d, _ in source)
    assert {d: sum(r["length"] for r in p) for d, p in pieces.items()} == {d: copies[d] * len(word_ids(t)) for d, t in source}
    return [sum(n for _, n in p) for p in windows.values()]


def test_packing(spark, docs, edges):
    fills = check_packing(QUERIES["op1_packing"](spark, SF_DIR).collect(), texts(docs))
    assert sum(f < 2048 for f in fills) <= docs.rdd.getNumPartitions()
    check_packing(packing.pack(edges, WORD_BPE).collect(), texts(edges))
    assert packing.pack(edges.limit(0), WORD_BPE).count() == 0


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(2)
    packer = packing.Packer(window=40)
    for k in range(500):
        size = rng.randint(1, 39)
        counts = packer.levels.copy()
        before = (counts[1:40] ** 2).sum()

        def after(h, counts=counts, size=size):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + size < 40:
                c[h + size] += 1
            return (c[1:40] ** 2).sum() - before

        options = [h for h in range(40 - size + 1) if h == 0 or counts[h]]
        assert after(packer._level(size)) == min(map(after, options))
        packer.add(k, np.arange(size, dtype=np.int32))
    packer.finish()
    assert sum(r[2] for r in packer.rows) == sum(len(set(range(r[1], r[1] + r[2]))) for r in packer.rows)


def test_word_bpe_is_the_library():
    rng = random.Random(1)
    letters = list("ab's't 're  12²½ªµ.,!?\n\t\x85\xa0\x1c\x1d<|endoftext|>İıŁſΣσςéé́ö日本🙂ǅﬁA")
    made = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)] + ["x" * 5000, "l'l'll'LL I'M", ""]
    made += ["".join(chr(rng.randint(0, 0x17F)) for _ in range(40)) for _ in range(500)]
    made += ["hello <|endoftext|> world <|startoftext|>", "a<|ENDOFTEXT|>b", "<|endoftext|>", "<|endoftext |>"]
    for special in (True, False):
        assert [list(x) for x in WordBpe(WORD_BPE, special).encode(made)] == [word_ids(t, special)[:-1] for t in made]
    assert word_ids(made[-4])[:-1] == [3306, 49407, 1002, 49406]


# --- 2 token counts


@pytest.mark.parametrize("block", [1, 7, 100])
def test_separator_scan(spark, block, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN", 3)
    rng, rows, expected = np.random.default_rng(block), [], []
    for file_id in range(3):
        ids = rng.integers(0, 4, 200)
        ends = np.flatnonzero(ids == 0)
        for k, (a, b) in enumerate(zip(np.concatenate([[-1], ends[:-1]]), ends)):
            expected.append((file_id, k, int(a) + 1, int(b - a - 1)))
        rows += [(file_id, i // block, bytearray(ids[i : i + block].astype("<u2").tobytes())) for i in range(0, 200, block)]
    blocks = spark.createDataFrame(rows, "file_id long, block long, tokens binary")
    assert sorted(map(tuple, token_counts.count_tokens(blocks, 0).collect())) == sorted(expected)
    left = {r["file_id"]: r["n_tokens"] for r in token_counts.unclosed(blocks, 0).collect()}
    assert left == {f: 200 - 1 - max(s + n for g, _, s, n in expected if g == f) for f in range(3)}


def test_token_counts_of_documents(spark, docs, edges):
    for df, block in ((docs, 1 << 20), (edges, 50)):
        counted = token_counts.document_token_counts(df, WORD_BPE, 49407, block)
        assert sorted(((r["doc_id"] or -1), r["n_tokens"]) for r in counted.collect()) == sorted(((d or -1), len(word_ids(t, False)) - 1) for d, t in texts(df))
    assert token_counts.document_token_counts(edges.limit(0), WORD_BPE, 49407).count() == 0


# --- 3 and 8 quality


def rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, labels, edges):
    model = quality_rules.fit(docs, labels)
    for df in (docs, edges):
        rows = quality_rules.apply(df, model).collect()
        assert len(rows) == df.count()
        source = collections.defaultdict(set)
        for d, t in texts(df):
            source[d].add(rules(t))
        for r in rows:
            counts = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            assert counts in source[r["doc_id"]]
            assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.keep(docs, model).count() == sum(r["kept"] for r in quality_rules.apply(docs, model).collect())
    assert quality_rules.keep(edges, model).columns == edges.columns
    assert quality_rules.apply(edges.limit(0), model).count() == 0
    assert quality_rules.fit(docs, labels.limit(0)) is None and quality_rules.apply(edges, None).count() == len(EDGES)


def test_quality_on_held_out_rows(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op3_quality_rules"](spark, sf).collect()
    tested = [(r["quality"] >= 0.5, labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels and not r["base_failed"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(tested) > 50 and np.mean([a == b for a, b in tested]) > 0.95
    rows = [r for r in QUERIES["op8_quality_knn"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_knn_is_an_exact_vote(docs, labels, edges):
    model = quality_knn.fit(docs, labels)
    tied = quality_knn.Model(model.idf, model.basis, np.ones((3000, 1), np.float32), np.array([1.0] * 15 + [0.0] * 2985))
    assert tied.vote(np.ones((2, 1), np.float32)) == pytest.approx([15.025 / 15.05] * 2)
    sample = [t for _, t in texts(docs)[:40]]
    v = model.project(features.unit_rows(sample, model.idf))
    got = model.vote(v)
    for row, score in zip(v, got):
        near = sorted(range(len(model.y)), key=lambda k: -float(model.vectors[k] @ row))[: quality_knn.NEIGHBOURS]
        w = np.array([max(float(model.vectors[k] @ row), 0) ** quality_knn.SHARPNESS for k in near])
        assert score == pytest.approx((w @ model.y[near] + 0.025) / (w.sum() + 0.05), abs=1e-3)
    assert model(["", " "]) == pytest.approx([0.5, 0.5])
    assert quality_knn.score(edges, model).count() == len(EDGES) and quality_knn.score(edges.limit(0), model).count() == 0
    nothing = quality_knn.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_knn.score(edges, nothing).collect()} == {0.5}


# --- 4 personal data

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def made_of_pieces(n):
    rng = random.Random(3)
    whole = ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "+1 (988) 555-2485", "12.34.56.78", "4041894974608795"]
    small = ["0123456789", "+", ". ", "-()", "@ab.é😀", "4111 1", "a@b.c_", "1.2.3.4.5"]
    return ["".join(rng.choice(rng.choice(small)) if rng.random() < 0.7 else rng.choice(whole) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_base_spans(spark, docs, edges):
    long = ["a" * 50000, "1" * 50000, "a@b" + ".c" * 20000, "1." * 20000, "+1" + "(" * 20000, "a@" * 20000]
    made = spark.createDataFrame(list(enumerate(made_of_pieces(1500) + long)), "doc_id long, text string")
    for df in (made, docs, edges):
        source = collections.defaultdict(set)
        for d, t in texts(df):
            source[d].add(",".join(base_spans(t)))
        for r in pii.find(df, pii.fit(df)).collect():
            expected = next(iter(source[r["doc_id"]]))
            assert r["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest()
            assert [r[f"n_{k}"] for k in KINDS] == [len(re.findall(rf"(?:^|,){k}:", expected)) for k in KINDS]
            assert set(filter(None, expected.split(","))) <= set(r["spans"].split(","))
    assert pii.find(edges.limit(0), pii.fit(edges.limit(0))).count() == 0


def test_secrets_are_added_and_redacted(spark):
    rng = random.Random(5)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(60)]
    rows = [(i, f'set token = "{h}" now' if i % 2 else f"the password={h[:20]} was") for i, h in enumerate(hexes)]
    rows += [(100 + i, f"at commit {h}/ we saw") for i, h in enumerate(hexes[:20])] + [(200, "plain supercalifragilisticexpialidocious words"), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars", "7 AS __extra")
    model = pii.fit(df)
    found = {r["doc_id"]: r["spans"] for r in pii.find(df, model).collect()}
    assert all(found[i].startswith("secret:") for i in range(60)) and found[200] == found[201] == ""
    out = {r["doc_id"]: r for r in pii.redact(df, model).collect()}
    assert out[1]["text"] == 'set token = "<SECRET>" now' and out[1]["n_chars"] == len(out[1]["text"]) and out[1]["__extra"] == 7
    assert out[201]["text"] is None


def test_long_secrets_are_candidates(spark):
    rng = random.Random(6)
    made = lambda n: "".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n))
    rows = [(i, f'set token = "{made(60 if i < 40 else 100 * i)}" now') for i in range(60)] + [(60, "1a" * 500000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(df, pii.fit(df)).collect()}
    assert all(out[i] == 'set token = "<SECRET>" now' for i in range(60))


def test_names_addresses_and_accounts(spark):
    rows = [
        (1, "Dear Mr. John Smith, contact Anna Müller or the James Joyce Committee."), (2, "IBAN: GB29 NWBK 6016 1331 9268 19, not GB29 NWBK 6016 1331 9268 18"),
        (3, "he lives at 12 Baker Street, London and in der Goethestraße 12a"), (4, "SSN 123-45-6789, part 000-45-6789"), (5, "The And Of 12 345 plain"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS base", "3 AS wide", "4 AS spans")
    out = pii.redact(df, pii.fit(df))
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == "Dear <NAME>, contact <NAME> or the James Joyce Committee." and texts[2].startswith("IBAN: <IBAN>, not GB29")
    assert texts[3] == "he lives at <ADDRESS>, London and in der <ADDRESS>" and texts[4] == "SSN <SSN>, part 000-45-6789" and texts[5] == rows[4][1]


def test_many_spans_in_one_text(spark):
    """Time grows with the text, also where it holds thousands of spans; what cuts through a base span goes."""
    took = []
    for n in (2000, 8000):
        text = " ".join(f"user{i}@mail.com tok{i}abcdef0123456789 x{i}y1234567890123@a.co" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        model = pii.fit(df)
        began = time.time()
        row, new = pii.find(df, model).first(), pii.redact(df, model).first()["text"]
        took.append(time.time() - began)
        assert row["n_email"] == 2 * n and new.split(" ")[::3] == ["<EMAIL>"] * n and "@" not in new
    assert took[1] < 4 * took[0]


def test_personal_data_runs_no_python(docs):
    plan = pii.find(docs, pii.fit(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 5 toxicity


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 9):
        s, first = rng.normal(size=n), rng.random(n) < 0.4
        first[0] = True
        trans, start = np.exp(rng.normal(size=(2, 2))), np.exp(rng.normal(size=2))
        total, prob, moves = 0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            w = np.prod([(start[b] if first[t] else trans[path[t - 1], b]) * np.exp(s[t] * b) for t, b in enumerate(path)])
            total, prob = total + w, prob + w * np.array(path)
            for t in range(1, n):
                if not first[t]:
                    moves[path[t - 1], path[t]] += w
        got, got_moves = toxicity.marginals(s, first, trans, start, pairs=True)
        assert np.allclose(got, prob / total) and np.allclose(got_moves, moves / total)


def test_toxicity(spark, edges):
    sf = SF_DIR.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert model.fitted
    bad = "what an idiot you moron, stupid clown"
    made = spark.createDataFrame([(1, f"the and of {bad} and of the that"), (2, "the and of the that"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in toxicity.score(made, model).collect()}
    assert rows[1]["predicted"] == 1 and rows[2]["predicted"] == rows[3]["predicted"] == 0
    text = made.first()["text"]
    assert any("idiot" in text[int(a) : int(b)] for a, b in (x.split(":") for x in rows[1]["spans"].split(",")))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in toxicity.score(docs, model).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] for r in held if not truth[r["doc_id"]]]) < 0.05
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]]]) > 0.5
    assert toxicity.score(edges, model).count() == len(EDGES) and toxicity.score(edges.limit(0), model).count() == 0
    assert toxicity.keep(docs, model).count() == toxicity.score(docs, model).where("predicted = 0").count()
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(edges, none).collect()} == {0.0}


def chain_by_hand(model, words):
    """Marginals by the forward and backward sums of one document, a word at a time."""
    if not words:
        return []
    own = [[int(x) & ((1 << toxicity.BITS) - 1) for x in toxicity.forms(w)] for w in words]
    s = [float(model.own[f].sum()) for f in own]
    for t in range(len(words)):
        if t:
            s[t] += float(model.before[own[t - 1][0]])
        if t + 1 < len(words):
            s[t] += float(model.after[own[t + 1][0]])
    e = [(1.0, float(np.exp(np.clip(x, -30, 30)))) for x in s]
    norm = lambda v: [x / sum(v) for x in v]
    ahead = [norm([model.start[j] * e[0][j] for j in (0, 1)])]
    for x in e[1:]:
        ahead.append(norm([sum(ahead[-1][i] * model.trans[i, j] for i in (0, 1)) * x[j] for j in (0, 1)]))
    back = [[0.5, 0.5]]
    for x in e[:0:-1]:
        back.append(norm([sum(model.trans[i, j] * x[j] * back[-1][j] for j in (0, 1)) for i in (0, 1)]))
    both = [(a[0] * b[0], a[1] * b[1]) for a, b in zip(ahead, back[::-1])]
    return [one / (zero + one) for zero, one in both]


def test_toxicity_query_by_hand(spark, docs, labels):
    """The query on a small table: every score from the chain's own sums; a ranking though six labels are toxic."""
    model = toxicity.fit(docs, labels)
    rows = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, SF_DIR).collect()}
    source = texts(docs)
    assert len(rows) == len(source)
    for doc, text in source:
        p = chain_by_hand(model, re.findall(rb"[^ \t-\r]+", text.encode().lower()))
        top = min(max(max(p, default=0.0), 1e-4), 1 - 1e-4)
        z = model.slope[0] * np.log(top / (1 - top)) + model.slope[1] * np.log1p(sum(x for x in p if x > 0.5)) + model.offset
        assert rows[doc]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
        assert rows[doc]["predicted"] == int(rows[doc]["score"] >= 0.7) and rows[doc]["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1)
    assert len({round(r["score"], 9) for r in rows.values()}) > 50


def auc(scores, y):
    scores, y = np.array(scores), np.array(y)
    up, down = scores[y == 1][:, None], scores[y == 0][None]
    return float(((up > down) + 0.5 * (up == down)).mean())


def test_toxicity_ranks_held_out_rows(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert auc([r["score"] for r in rows], [truth[r["doc_id"]] for r in rows]) > 0.9


# --- 6 byte-level BPE


def byte_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_is_the_library():
    bpe, library = byte_bpe.ByteBpe(BYTE_BPE, public_tokenizers.PATTERN), byte_library()
    rng = random.Random(1)
    letters = list("ab's't 're  12²½ªµ.,!?\n\t\x85\xa0\x1c\x1d İıŁſΣσςéé́ö日本🙂ǅﬁA")
    made = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    made += ["".join(rng.choices("etaoinshrdlu", k=30)) for _ in range(2000)] + ["x" * 5000, "<|endoftext|> a", "a" * 9999, " " * 99, "\n" * 50, ""]
    for t in made:
        assert bpe.encode(t) == library.encode_ordinary(t)
        assert "".join(bpe.decode(bpe.encode(t), chunk=3)) == t
    bpe.transducer._reset()
    assert bpe.transducer.encode(b" encyclopaedias") == library.encode_ordinary(" encyclopaedias")


def test_utf8_machine_in_any_chunks():
    rng = random.Random(9)
    some = ["a", "é", "ß", "日", "🙂", "\U0010ffff"]
    for _ in range(3000):
        raw = b"".join(rng.choice([rng.choice(some).encode(), rng.choice(some).encode()[:1], bytes([rng.randrange(256)])]) for _ in range(8))
        machine, out, at = byte_bpe.Utf8Machine(), [], 0
        while at < len(raw):
            step = rng.randint(1, 4)
            out.append(machine.feed(raw[at : at + step]))
            assert len(machine.held) < 4
            at += step
        assert "".join([*out, machine.finish()]) == raw.decode("utf-8", "replace")


def test_round_trip(spark, docs, edges):
    encoding = byte_library()
    for df in (docs, edges):
        sent = collections.Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in texts(df))
        rows = byte_bpe.round_trip(df, BYTE_BPE, public_tokenizers.PATTERN).collect()
        assert collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in rows) == sent
        ids = [(d, encoding.encode_ordinary(t)) for d, t in texts(df)]
        digest = lambda x: hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in rows) == collections.Counter((d, len(x), digest(x)) for d, x in ids)
        ids = byte_bpe.encode(df, BYTE_BPE, public_tokenizers.PATTERN)
        back = byte_bpe.decode(ids, BYTE_BPE, public_tokenizers.PATTERN)
        assert collections.Counter(map(tuple, back.collect())) == collections.Counter(texts(df))
    assert byte_bpe.round_trip(edges.limit(0), BYTE_BPE, public_tokenizers.PATTERN).count() == 0


# --- 7 fingerprints


def test_edited_fingerprints(spark, docs):
    rows = sorted(QUERIES["op7_fingerprints"](spark, SF_DIR).collect(), key=lambda r: -r["doc_id"])
    source = sorted(texts(docs), reverse=True)
    for (doc, text), r, following in zip(source, rows, [t for _, t in source[1:] + source[:1]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (doc, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["edited_fingerprint"] == fingerprints.digest(fingerprints.canonical(edited))
        assert r["fingerprint"] == fingerprints.digest(fingerprints.canonical(text))
        assert r["near_next"] == (fingerprints.canonical(text) == fingerprints.canonical(following))
        assert r["near_edited"] == (fingerprints.canonical(text) == fingerprints.canonical(edited))


def test_fingerprint_edges(spark, edges):
    rows = fingerprints.edited_fingerprints(edges).collect()
    assert len(rows) == len(EDGES) and len({r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert fingerprints.edited_fingerprints(edges.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(edges.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0
    groups = {r["doc_id"]: r["group_id"] for r in fingerprints.exact_groups(edges).collect()}
    assert groups[5] == 4 and groups[2] == groups[3] == 1


def test_bytes_decide_inside_a_bucket(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    marked = df.selectExpr("doc_id", "'same' AS fingerprint")
    monkeypatch.setattr(fingerprints, "digests", lambda docs: docs)
    members = df.selectExpr("doc_id", "'same' AS digest", "text AS canonical")
    monkeypatch.setattr(fingerprints, "map_slices", lambda *a, **k: members)
    out = {r["doc_id"]: r["fingerprint"] for r in fingerprints._resolved(df, marked).collect()}
    assert out[1] == out[3] == "same" and out[2].startswith("same-")


# --- 9 HTML


def test_html(spark):
    rows = QUERIES["op9_html_extraction"](spark, SF_DIR).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    import html as lib

    for r in rows:
        body = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(lib.unescape(re.sub("</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_html_edges(spark):
    trees = html_text.fit()
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<"), (4, None, "<p" * 2000), (5, "u", "<div>" * 3000 + "x"), (6, "u", "<script>never closed"), (6, "u", "<!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_text.main_text(df, trees)
    assert out.count() == len(rows) and html_text.main_text(df.limit(0), trees).count() == 0
    page = '<body><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="content"><h1>Title &amp; more</h1><p>First  long\nparagraph of text, which goes on for a while.<p>Second&nbsp;one, which goes on for a while too.</div><div class="comments"><p>me too</p></div><footer>(c)</footer>'
    assert html_text.extract([page], trees) == ["Title & more\nFirst long paragraph of text, which goes on for a while.\nSecond one, which goes on for a while too."]


@pytest.mark.parametrize("tag", ["<svg class='i' />", "<math/>", "<video src='x'>", "<object data='x'>", "<iframe src='x'>", "<canvas>", "<audio>", "<select>", "<svg><path d='x'/></svg>"])
def test_text_after_an_element_that_nothing_closes(tag):
    texts = ["First long paragraph of text, which goes on for a while.", "Second one, which goes on for a while too, and then some more."]
    runs = html_text.Page(f"<body><article><p>{texts[0]}</p>{tag}<p>{texts[1]}</p></article></body>").runs
    assert [text for _, text in runs] == texts


def test_formulas_are_text_and_scripts_run_on():
    runs = html_text.Page("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><script>never <p>closed</p>").runs
    assert [text for _, text in runs] == ["So x=1 holds."]
    assert html_text.Page("<video>" * 20000 + "x").runs[0][1] == "x"


FIRST, SECOND = "First long paragraph of text, which goes on for a while, and then a bit.", "Second one, which goes on for a while too, and then some more words here."
NAV, FOOT = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>', "<footer>(c) 2020 Some company</footer>"
COMMENTS = '<div id="comments"><h3>2 replies</h3><div class="comment"><p>me too, I think this is right</p></div><div class="comment"><p>no way at all</p></div></div>'
BODY = f"<h1>Title</h1><p>{FIRST}</p><p>{SECOND}</p>"
REFERENCES = "".join(f'<li><a href="#">Reference number {i} of the study</a></li>' for i in range(6))
LAYOUTS = {
    "links in the article": (f"{NAV}<article>{BODY}<h2>References</h2><ul>{REFERENCES}</ul></article>{FOOT}", ["References", *(f"Reference number {i} of the study" for i in range(6))]),
    "comments in main": (f"{NAV}<main>{BODY}{COMMENTS}</main>{FOOT}", []),
    "a plain division": (f"<div class='header'><a href='/'>Site</a></div><div id='content'>{BODY}</div><div class='sidebar'><h3>Popular</h3><ul><li><a>x y</a></li></ul></div>{COMMENTS}{FOOT}", []),
    "no container": (f"{NAV}{BODY}{FOOT}", []),
    "a section with an advert": (f"<header><h2>Site</h2>{NAV}</header><section class='post'>{BODY}<div class='ad-slot'>Buy now</div></section><aside>Related things</aside>{FOOT}", []),
    "forms and notices": (f"{NAV}<div class='entry-content'>{BODY}</div><form action='/s'><label>Search</label><input></form><div class='cookie-notice'><p>We use cookies, do you agree to that?</p></div>{FOOT}", []),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_html_layouts(layout):
    body, more = LAYOUTS[layout]
    assert html_text.extract([f"<body>{body}</body>"], html_text.fit()) == ["\n".join(["Title", FIRST, SECOND, *more])]


@pytest.mark.parametrize("tag", ["<b>", "<blockquote>", "<div>", "<li>", "<b>x<p>"])
def test_unclosed_tags_take_linear_time(tag):
    trees, began = html_text.fit(), time.time()
    html_text.extract([f"{tag}y " * 16000], trees)
    assert time.time() - began < 8


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(4)
    for _ in range(20):
        page = html_text.Page("<div>" + "".join(rng.choice(["<div>", "</div>", "<p>x</p>"]) for _ in range(7)))
        forest = html_text.Forest([page])
        p, n = rng.random(len(page.tags)), len(page.tags)
        best = max(
            (k for k in itertools.product((0, 1), repeat=n) if k[0] and all(k[forest.parent[i]] or not k[i] for i in range(n))),
            key=lambda k: sum(np.log(p[i] if k[i] else 1 - p[i]) for i in range(1, n)),
        )
        assert forest.decode(p).tolist() == [bool(x) for x in best]


# --- 10 SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[max(find(i), find(j))] = min(find(i), find(j))
    lowest = {}
    for i, d in enumerate(ids):
        if d is not None:
            lowest[find(i)] = min(d, lowest.get(find(i), d))
    return [lowest.get(find(i)) for i in range(len(fps))]


def test_simhash(spark, docs, edges):
    near = [(1000 + i, docs.first()["text"] + f" tail{i % 7}") for i in range(40)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    for df in (more, edges):
        source = texts(df)
        fps = [brute_fingerprint(t) for _, t in source]
        expected = collections.Counter((d, f"{f:016x}", c) for (d, _), f, c in zip(source, fps, brute_components([d for d, _ in source], fps)))
        assert collections.Counter(map(tuple, simhash.near_duplicates(df).collect())) == expected
    assert simhash.near_duplicates(edges.limit(0)).count() == 0


@pytest.mark.parametrize("bits,radius,block", [(64, 2, 4096), (64, 2, 16), (128, 9, 4096)])
def test_bit_sliced_links(spark, bits, radius, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(bits + block)
    base = rng.integers(0, 256, (6, bits // 8), dtype=np.uint8)
    flips = rng.random((300, bits)) < radius / bits * 0.6
    fps = np.unique(np.packbits(np.unpackbits(base[rng.integers(0, 6, 300)], axis=1) ^ flips, axis=1), axis=0)
    one_table = [np.array([0])]
    df = spark.createDataFrame([(bytearray(f.tobytes()),) for f in fps], "fp binary")
    edges = simhash.links(df, one_table if block == 4096 else simhash.all_choices(64, 4, 2), radius)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    nodes = [simhash.node_of(f.tobytes()) for f in fps]
    d = (np.unpackbits(fps, axis=1)[:, None] != np.unpackbits(fps, axis=1)[None]).sum(2)
    if block == 4096:  # the only table parts rows by their first bit
        first = np.unpackbits(fps, axis=1, bitorder="little")[:, 0]
        d[first[:, None] != first[None]] = bits
    label = simhash._components(len(fps), *np.nonzero(d <= radius))
    assert len({roots.get(n, n) for n in nodes}) == len(set(label.tolist()))
    for members in (np.flatnonzero(label == k) for k in set(label.tolist())):
        assert len({roots.get(nodes[m], nodes[m]) for m in members}) == 1


def test_corpus_near_duplicates(spark, edges):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    base = [rng.sample(words, 200) for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:20]):
        copy = list(b)
        copy[rng.randrange(200)] = "changed"
        rows.append((100 + i, " ".join(copy)))
    names = "id same node fp key keys size part ask hub leaf row __keep __row first n count".split()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"{k} AS {c}" for k, c in enumerate(names)))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(30))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.drop_near_duplicates(edges).collect()) == sorted(
        {(1, ""), (4, "One"), (0, "no id"), (6, "word " * 4000), (7, "a" * 30000), (10, EDGES[9][1]), (8, EDGES[10][1]), (9, EDGES[11][1])}
    )


def similar_roots(texts, similarity=0.8):
    """Brute force: smallest position in each group of texts that links of exact similarity join."""
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holds = collections.defaultdict(list)
    for i, own in enumerate(sets):
        shared = collections.Counter(j for x in own for j in holds[x])
        for j, n in shared.items():
            if n >= similarity * (len(own) + len(sets[j]) - n) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
        for x in own:
            holds[x].append(i)
    empty = [i for i, own in enumerate(sets) if not own]
    return [empty[0] if i in empty else find(i) for i in range(len(sets))]


def edits(rng, base, n, changes, places):
    made = []
    for i in range(n):
        edit = list(base)
        for k in rng.sample(places, changes):
            edit[k] = f"new{i}x{k}"
        made.append(" ".join(edit))
    return made


def one_bucket(monkeypatch):
    marks = simhash.corpus_marks
    monkeypatch.setattr(simhash, "corpus_marks", lambda *a: marks(*a).withColumn("keys", F.array(F.lit(0).cast("long"))))


def test_a_false_link_hides_no_true_one(spark, monkeypatch):
    """Many edits of one text: some lie nearer to each other than to the text they are like."""
    one_bucket(monkeypatch)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(404)]
    texts = [" ".join(base), *edits(rng, base, 120, 7, range(5, 399, 5))]
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    assert all(len(sets[0] & x) / len(sets[0] | x) > 0.8 for x in sets[1:])
    assert sum(len(a & b) / len(a | b) < 0.8 for a, b in itertools.combinations(sets[1:], 2)) > 6000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()] == [0]


@pytest.mark.parametrize("seed", [1, 2])
def test_large_buckets_lose_no_link(spark, monkeypatch, seed):
    """All texts in one bucket that is dealt out as many blocks: chains, stars and loose texts."""
    one_bucket(monkeypatch)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(seed)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(200)]
        texts += [" ".join(base), *edits(rng, base, 25, 3, range(5, 195, 5))]
    chain = [f"c{i}" for i in range(200)]
    for i in range(30):  # each is like the one before, not like the first
        chain[6 * i % 190] = f"step{i}"
        texts.append(" ".join(chain))
    texts += [" ".join(f"own{i}x{k}" for k in range(60)) for i in range(20)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()) == sorted(set(similar_roots(texts)))


def test_recall_against_exact_similarity(spark):
    """Pairs at every similarity from 0.8 up share a group, and none below is joined but by others."""
    rows = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r["text"] for r in rows]
    rng = random.Random(4)
    for i in range(150):  # about 0.80 to 0.95
        base = [f"t{i}w{k}" for k in range(300)]
        texts += [" ".join(base), *edits(rng, base, 2, 1 + i % 6, range(5, 295, 6))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected, kept = set(similar_roots(texts)), {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    dropped = len(texts) - len(expected)
    assert expected <= kept and len(kept - expected) <= 0.02 * dropped


def test_repeats_make_no_near_duplicates(spark):
    """A passage repeated in two unrelated texts; without its repeats it is a small part of either."""
    passage = " ".join(f"p{k}" for k in range(30)) + " "
    rows = [(i, passage * 40 + " ".join(f"own{i}x{k}" for k in range(1250))) for i in range(6)]
    rows += [(10 + i, passage * 4000 + f"end{i} " + " ".join(f"t{i}x{k}" for k in range(30))) for i in range(3)]
    rows += [(20, rows[0][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()) == [*range(6), 10, 11, 12]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_salted(spark, monkeypatch, how):
    monkeypatch.setattr(common, "LEAST", 5)
    rows = [(bytearray([k % 4 if k < 80 else k]), k) for k in range(120)]
    left = spark.createDataFrame(rows, "fp binary, id long")
    right = left.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("hex(fp) <> '02'").withColumn("name", F.hex("fp"))
    plain, salted = left.join(right.drop("n"), "fp", how), common.join_hot(left, right, "fp", 120, how)
    assert salted.columns == plain.columns and sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_groups_with_hot_keys(spark, monkeypatch):
    """The query with every key taken for hot gives the same groups."""
    rows = [(i, f"one two three four {i % 3}" if i < 60 else f"other {i} text {i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    monkeypatch.setattr(common, "LEAST", 0)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == expected


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF_DIR)
        assert after.columns == docs.columns and after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0, name
        before = after
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.select("doc_id").collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0
