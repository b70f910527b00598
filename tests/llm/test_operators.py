"""Chat, secrets, languages, neighbours, quality, surrogates and the pipeline on small fixtures."""

import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagegauge.llm import chat, decontaminate, langid, minhash, multiindex, pii, quality, secrets
from pagegauge.llm.queries import QUERIES, SQL
from tests.llm.test_duplicates import brute_components
from tests.llm.test_texts import docs_of

DATA = "/root/testdata/sf0.001"


def messages_of(spark, rows):
    return spark.createDataFrame(
        rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")


def test_paths_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0),
            (1, 4, 2, "user", "c", 0.0), (1, 5, 4, "assistant", "d", 0.5), (1, 6, 99, "user", "orphan", 9.0),
            (2, 1, 2, "user", "x", 1.0), (2, 2, 1, "user", "y", 1.0), (2, 3, 2, "assistant", "z", 1.0)]
    rows += [(3, k, k - 1 if k else None, "user", f"t{k}", 0.0) for k in range(40)]
    found = chat.paths(messages_of(spark, rows)).collect()
    got = {}
    for r in found:
        got.setdefault((r.tree_id, r.leaf), []).append((-r.up, r.msg_id))
    assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == {
        (1, 3): [1, 3], (1, 5): [1, 2, 4, 5], (1, 6): [6], (3, 39): list(range(40))}
    best = chat.ranked(messages_of(spark, rows), 2).select("tree_id", "leaf", "rank").distinct().collect()
    assert sorted(map(tuple, best)) == [(1, 3, 2), (1, 6, 1), (3, 39, 1)]
    every = chat.ranked(messages_of(spark, rows), None).select("tree_id", "leaf", "rank").distinct().collect()
    assert (1, 5, 3) in set(map(tuple, every))


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\nhi", "<s>", "<\\s> </s> [INST]\\[/INST] [\\\\INST]", "a\\b <<s>", "", None, "<", "é日🙂"]
    turns = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant"] * 4, nasty))]
    turns += [(None, 1, "assistant", "x"), (None, None, "sys%tem\nrole", "y"), (7, 0, None, None), (8, 1, "user", "b"), (8, 1, "user", "a")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    done = chat.formatted(chat.ranked(chat.linear(rows)))
    got = {r.conv_id: r for r in chat.read_back(done).collect()}
    by = {}
    for c, t, r, x in sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    for c, own in by.items():
        whole, learnt = "".join(f"{r}\n{x}\n" for r, x in own), "".join(x for r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    text = done.where("tree_id = 1").first()
    assert text.formatted.count("<|im_end|>") == len(nasty) and len(text.formatted) == got[1].formatted_chars
    assert "</s>" not in text.formatted and "[INST]" not in text.formatted
    assert chat.read_back(chat.formatted(chat.ranked(chat.linear(rows.limit(0))))).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans(spark):
    rng = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "ab", "AKIA", "ABCDEF1234567890", "0123456789abcdef",
            "secret", "é日", "\n", "Zz9+/_.=-x", "hunter22", "ghp_" + "a1" * 20]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    texts += [None, "", "token=ab: secret: abcdefgh", "token=token: secret123", "AKIAAKIA" + "A" * 20]
    rows = [(k, t, rng.choice(["s1", "s2", None])) for k, t in enumerate(texts)] + [(None, "token=abcdef123456", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scanned = secrets.scan(docs, "doc_id", "source")
    got = {r.doc_id: r for r in secrets.report(scanned).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        spans = base_spans(t or "")
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(s[1] == n for s in spans) for n in range(3)]
        assert {s for s in joined.split(",") if s} <= set(got[k].spans.split(","))
    kept = secrets.masked(docs.withColumn("_hits", F.lit(1)), scanned)
    assert kept.columns == ["doc_id", "text", "source", "_hits"] and kept.count() == len(rows)
    for r in kept.collect():
        before = {k: t for k, t, _ in rows}[r.doc_id]
        if not base_spans(before or "") and "ghp_" not in (before or ""):
            assert r.text == before
        else:
            assert "[secret]" in r.text


def test_widely_copied_examples_stay(spark):
    shared, own = "token=4f3a9c1e7b2d8e6f0a1b", "token=9d8c7b6a5f4e3d2c1b0a"
    rows = [(k, f"see {shared} here", f"owner{k % 12}") for k in range(40)]
    rows += [(100 + k, f"keep {own} away", "owner1") for k in range(30)] + [(200, "token=aaaaaaaa", "owner1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scanned = secrets.scan(docs, "doc_id", "source")
    got = {r.doc_id: (r.n_live, r.n_shared) for r in secrets.report(scanned).collect()}
    assert got[0] == (0, 1) and got[100] == (1, 0) and got[200] == (0, 0)
    text = {r.doc_id: r.text for r in secrets.masked(docs, scanned).collect()}
    assert shared in text[0] and text[100] == "keep token=[secret] away"


def test_rows_without_an_id_are_masked_and_cleaned_by_their_own_text(spark):
    value = "token=9d8c7b6a5f4e3d2c1b0"
    rows = [(i, f"{'pad ' * n}{value}{n} end", "s") for i in (None, 5) for n in range(6)]
    rows += [(None, "a clean text that is long enough to be cut", "s"), (5, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.masked(docs, secrets.scan(docs, "source", "source")).collect()
    want = [(i, t and re.sub("=9d8c\\w+", "=[secret]", t)) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    item = "the quick brown fox jumps over the lazy dog by the river bank"
    more = [(None, f"x {item} y", "s"), (None, "free", "s"), (7, item, "s"), (7, "free too", "s")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.clean(spark.createDataFrame(more, docs.schema), bench, nameless=True)
    assert sorted(r.text for r in kept.collect()) == ["free", "free too"]


def test_masked_text_equals_brute_force(spark):
    rng = random.Random(8)
    bits = ["token=", "secret: ", "é ", "0123456789abcdef" * 2, "AKIA" + "A7" * 9, "ghp_" + "a1" * 20, " ", "plain\n", "日"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", "token=" + "0123456789abcdef" * 2, "x" * 70000 + " token=9d8c7b6a5f4e3d2c1b0"]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    scanned = secrets.scan(docs, "doc_id", "source").cache()
    spans = {r.doc_id: sorted((s["from"], s["end"]) for s in r.spans) for r in scanned.collect()}
    for r in secrets.masked(docs, scanned).collect():
        want, at = "", 0
        for start, end in spans[r.doc_id]:
            if start >= at:
                want += (r.text and texts[r.doc_id][at:start]) + "[secret]"
            at = max(at, end)
        assert r.text == (texts[r.doc_id] and want + texts[r.doc_id][at:])


def test_a_log_of_many_secrets_takes_seconds(spark):
    lines = [f"{k} token=9d8c7b6a5f4e{k:08d} end" for k in range(20000)]
    docs = spark.createDataFrame([(1, "\n".join(lines), "s")], "doc_id long, text string, source string")
    begun = time.monotonic()
    got = secrets.masked(docs, secrets.scan(docs, "doc_id", "source")).first()
    assert got.text == "\n".join(f"{k} token=[secret] end" for k in range(20000))
    assert time.monotonic() - begun < 60


def test_rows_without_an_id_own_only_their_own_values(spark):
    rows = [(None, f"token=9d8c7b6a5f4e3d2c{k}1b0", "s") for k in range(5)] + [(None, None, None), (None, "clean", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.report(secrets.scan(docs, "doc_id", "source")).collect()
    assert sorted(r.n_live for r in got) == [0, 0, 1, 1, 1, 1, 1]


def test_texts_are_joined_to_chosen_paths_only(spark):
    rows = [(1, 0, None, "user", "root " * 100, 0.0)] + [(1, k, 0, "assistant", f"t{k}", float(k)) for k in range(1, 50)]
    best = chat.ranked(messages_of(spark, rows), 1)
    assert sorted((r.msg_id, r.leaf) for r in best.collect()) == [(0, 49), (49, 49)]


def greedy(data, sample):
    n, i = 1, 0
    j = 0
    while j < len(data):
        if data[i:j + 1] in sample:
            j += 1
        elif j > i:
            n, i = n + 1, j
        else:
            n, i, j = n + 1, j + 1, j + 1
    return n


def test_phrases_equal_a_plain_parse():
    rng = random.Random(8)
    first = "".join(rng.choice("abcd ") for _ in range(500)).encode()
    second = "".join(rng.choice("cdef ") for _ in range(700)).encode()
    model = langid.Model([("x", first, b"ab cd"), ("y", second, b"cd ef")])
    texts = ["".join(rng.choice("abcdefz ") for _ in range(rng.randint(1, langid.BLOCK))).encode() for _ in range(50)]
    got = model._phrases(texts)
    for t, row in zip(texts, got):
        assert np.allclose(row * len(t), [greedy(t, first), greedy(t, second)])


def test_languages(spark):
    rng = random.Random(9)
    syllables = {"en": ["the", "and", "ing", "tion", "ough"], "de": ["sch", "ung", "der", "ich", "ein"], "el": ["και", "του", "στη", "ους"]}
    def prose(lang):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 200)))
    rows = [(k, prose(lang), lang) for k, lang in enumerate(["en", "de", "el"] * 60)] + [(900, "noise", None), (901, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [tuple(r) for r in langid.samples(docs.where("doc_id < 90")).collect()]
    assert sorted(f[0] for f in found) == ["de", "el", "en"]
    more = spark.createDataFrame([(950, None, "x"), (951, "", "x"), (952, "12 .!", "x"), (953, "ung\nschein " * 9000, "de")], docs.schema)
    got = {r.doc_id: r for r in langid.predict(docs.union(more), found).collect()}
    held = [r for r in rows if 90 <= r[0] < 900]
    assert np.mean([got[k].lang_pred == lang for k, _, lang in held]) > 0.97
    assert [(got[k].lang_pred, got[k].score) for k in (950, 951, 952)] == [("und", 0.0)] * 3 and got[953].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(docs, []).collect()} == {"und"}
    assert langid.predict(docs.limit(0), found).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(10)
    centers = rng.normal(0, 1, (20, 16))
    data = (centers[rng.integers(0, 20, 900)] + rng.normal(0, 0.2, (900, 16))).astype(np.float32)
    data[300:340] = data[300]  # more copies than neighbours asked for
    rows = [(k, v.tolist(), 1) for k, v in enumerate(data)]
    bad = [(900, None, 1), (1000, [0.0] * 16, 1), (1100, [float("nan")] * 16, 1), (1200, [1.0, None] * 8, 1),
           (1300, [float("inf")] * 16, 1), (None, data[0].tolist(), 1), (1400, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in multiindex.nearest(table, F.col("vec_id") % 20 == 0, centroids=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 900, 20))
    wide, hits = data.astype(float), 0
    for q, found in got.items():
        exact = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(900), exact)) if k != q][:10]
        assert sorted(found) == list(range(1, 11))
        assert [found[k] for k in range(1, 11)] == sorted(found.values(), key=lambda x: (x[1], x[0]))
        assert all(abs(s - exact[v]) < 1e-12 and v != q for v, s in found.values())
        hits += len(set(want) & {v for v, _ in found.values()})
    assert hits >= 9 * len(got)
    assert [got[300][k][0] for k in range(1, 11)] == list(range(301, 311))
    few = table.where("vec_id < 3")
    assert multiindex.nearest(few, F.col("vec_id") == 0).count() == 2
    assert multiindex.nearest(table.where("vec_id >= 1000"), F.col("vec_id") == 1000).count() <= 1
    assert multiindex.nearest(table.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize(("base", "spread"), [(1e6, 1e-3), (1e160, 1e158), (0.0, 1.0), (3e5, 1.0)])
def test_neighbours_far_from_the_origin(spark, base, spread):
    rng = np.random.default_rng(12)
    data = base * rng.choice([-1.0, 1.0], 8) + spread * rng.normal(0, 1, (600, 8))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = multiindex.nearest(table, F.col("vec_id") % 60 == 0, fraction=1.0, centroids=4).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}
    for q in range(0, 600, 60):
        exact = spread * np.sqrt((((data - data[q]) / spread) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(600), exact)) if k != q][:10]
        assert [got[q, k + 1][0] for k in range(10)] == want
        assert np.allclose([got[q, k + 1][1] for k in range(10)], exact[want], rtol=1e-9)


def test_neighbours_on_a_line(spark):
    table = spark.createDataFrame([(k, [float(k + 1)]) for k in range(50)], "vec_id long, embedding array<float>")
    found = multiindex.nearest(table, F.col("vec_id") == 20, k=3, fraction=1.0, centroids=4).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(19, 1.0), (21, 1.0), (18, 2.0)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="driver tables not present")
def test_recall_of_the_registered_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, data = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in QUERIES["op7_neighbours"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        order = np.lexsort((ids, np.sqrt(((data - data[q]) ** 2).sum(1))))
        hits += len(found[ids[q]] & set(ids[[k for k in order if k != q][:10]].tolist()))
    assert hits >= 9 * len(found)


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    first, second, sizes = rng.random(7), rng.random(5), rng.integers(0, 3, (7, 5))
    pairs = multiindex.visited(first, second, sizes, int(sizes.sum()))
    sums = [first[a] + second[b] for a, b in pairs]
    assert sums == sorted(sums) and len(pairs) == (sizes > 0).sum()


def test_network_gradient_and_whole_texts():
    net = quality.Network()
    rng = random.Random(3)
    parts = [quality.chunked(["".join(rng.choice("abc !") for _ in range(n))])[0] for n in (5, 700, 1500)]
    labels = np.array([1, 0, 1], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    def loss():
        top = [net.responses(p).astype(np.float64) for p in parts]
        f = np.array([np.concatenate([t.mean(0), t.max(0)]) for t in top])
        z = f @ net.p["out"] + net.p["base"]
        return np.mean(np.log1p(np.exp(-z)) + (1 - labels) * z)
    grads = net._gradients(parts, labels)
    for name, at in (("out", 3), ("base", 0), ("bias", 2)):
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-4
        up = loss()
        net.p[name][at] = kept - 1e-4
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / 2e-4 - grads[name][at]) < 2e-3
    chunks, counts = quality.chunked(["x" * 5000, "", "y" * quality.CHUNK])
    assert counts.tolist() == [-(-(5000 - quality.CHUNK) // quality.STEP) + 1, 1, 1]
    assert (chunks[:counts[0]] == ord("x")).sum() >= 5000


def test_quality_learns(spark):
    rng = random.Random(12)
    def good():
        return " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 300)))
    rows = [(k, good() if k % 2 else re.sub(" ", "*** ", good()), 0.1, "n", b"") for k in range(240)]
    docs = spark.createDataFrame(rows + [(500, None, 0.1, "n", b""), (501, "", 0.1, "n", b"")], docs_of(spark, []).schema)
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)] + [(None, 1), (3, None)], "doc_id long, label int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "node", "ids", "score"]
    got = {r.doc_id: r.score for r in scored.collect()}
    assert np.mean([(got[k] >= 0.5) == k % 2 for k in range(160, 240)]) > 0.95 and got[500] == got[501]
    assert quality.train(docs, labels.where("label = 1")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_surrogates(spark):
    texts = [(1, "Call +1 (017) 555-7713 or +1 017 555 7713, mail Anna.Bell7@mail.example.org"),
             (2, "mr. nobody; Mr. John Smith met Frau Müller, ANNA.BELL7@MAIL.EXAMPLE.ORG; 4111 1111 1111 1111 or 4111111111111112"),
             (3, "from 10.20.30.40, not 1.2.3.4.5; госпожа Анна Иванова"), (4, None), (5, ""), (2, "Frau Müller")]
    done = pii.pseudonymized(docs_of(spark, texts), b"key")
    assert done.columns[:5] == ["doc_id", "text", "score", "node", "ids"]
    rows = done.collect()
    got = {(r.doc_id, len(r.text or "") > 20): r for r in rows}
    a, b, c = got[1, True].text, got[2, True].text, got[3, True].text
    for text, before in ((a, texts[0][1]), (b, texts[1][1]), (c, texts[2][1])):
        assert len(text.split()) == len(before.split())
    phones = re.findall(r"\+1 [()\d -]{10,}\d", a)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and "555-7713" not in a
    assert re.search(r"\S+@\S+", a)[0].lower() == re.search(r"\S+@[^\s;]+", b)[0].lower() and "nobody" in b
    cards = re.search(r"(\d{4} \d{4} \d{4} \d{4}) or (\d{16})", b)
    right, wrong = cards[1].replace(" ", ""), cards[2]
    assert pii.check_digit(right[:-1]) == right[-1] and pii.check_digit(wrong[:-1]) != wrong[-1]
    assert re.search(r"Mr\. (\w+) \w+ met", b)[1] in pii.GIVEN["m", "LATIN"] and "1.2.3.4.5" in c and "10.20.30.40" not in c
    assert pii.script_of(c.rsplit(" ", 1)[1]) == "CYRILLIC" and c.split()[-2] in pii.GIVEN["f", "CYRILLIC"]
    short = next(r.text for r in rows if r.doc_id == 2 and len(r.text) < 20)
    assert short.split()[1] == re.search(r"Frau (\w+)", b)[1]
    assert [r.text for r in rows if r.doc_id in (4, 5)] == [None, ""]
    assert pii.pseudonymized(docs_of(spark, []), b"key").count() == 0


def test_telephone_numbers_are_found_whole_and_dates_are_not():
    numbers = ["06 12 34 56 78", "0171 2345678", "030 12345678", "555-1234", "0612345678", "+49 (0)171 2345678", "030/1234567",
               "(030) 12345678", "+1 (017) 555-7713", "1-800-555-1234", "12 34 56 78",
               "912 345 678", "+33612345678", "0171-2012-10-11"]
    for number in numbers:
        for before, after in (("", ""), ("Tel ", " today"), ("(", ")"), ("x\n", "\ny"), ("[", "], "), ("am 2024-01-15 ", "."), ("tel:", ";")):
            text = f"{before}{number}{after}"
            found = [(text[a:b], kind) for a, b, kind, _ in pii.detect(text)]
            assert found == [(number, "phone")], (text, found)
    for clean in ("am 2024-01-15 war", "2024-01-15", "(2024-01-15)", "15.01.2024", " 1/15/2024 ", "2024-01-15 10:30:00", "1234567",
                  "1,234,567", "3.1415926", "2019-2020", "1.2.3.4.5"):
        assert not pii.detect(clean), (clean, pii.detect(clean))


def test_amounts_and_years_are_no_telephone_numbers():
    for clean in ("10 000 000 people", "12.345.678", "x 1 234 567,89 EUR", "912 345 678 EUR", "$ 912 345 678", "1\u00a0234\u00a0567",
                  "1990-1995/2001-2003", "2019 - 2020 - 2021", "1 000 000 000 000 000"):
        for text in (clean, f"({clean})", f"a {clean}.", f"a {clean}, b"):
            assert not pii.detect(text), (text, pii.detect(text))
    for number in ("0171 22 345 678", "+49 30 123 456", "(030) 12 345 678", "912 345 678"):
        assert [number] == [f"x {number} y"[a:b] for a, b, _, _ in pii.detect(f"x {number} y")], number


def test_people_keep_their_surrogate_in_every_form(spark):
    texts = [(1, "Mr. John Smith came. Smith left; then Mr. Smith and JOHN SMITH and John-Smith met."),
             (2, "Herr Müller kam. Müller ging. Müllers Hund. Frau Müller blieb."),
             (3, "Dr Anna Schmidt sprach. Frau Schmidt ging, Anna Schmidt kam. Dr. Paul Schmidt, Herr Schmidt."),
             (4, "A long talk with Mr. Tom Long. Long ago. Tom Long said so."),
             (5, "Smith and Müller are in no text with a title."),
             (6, "Smith wrote to Mr. John Smith at smith@mail.org. Mr. Peter Smith answered, Smith said.")]
    rows = {r.doc_id: r.text for r in pii.pseudonymized(docs_of(spark, texts), b"key").collect()}
    first, last = re.match(r"Mr\. (\w+) (\w+) came", rows[1]).groups()
    assert {first, last}.isdisjoint({"John", "Smith"})
    assert rows[1] == (f"Mr. {first} {last} came. {last} left; then Mr. {last} and {first.upper()} {last.upper()} and {first}-{last} met.")
    man, woman = re.match(r"Herr (\w+) kam\. .* Frau (\w+) blieb", rows[2]).groups()
    assert man != woman and rows[2] == f"Herr {man} kam. {man} ging. Müllers Hund. Frau {woman} blieb."
    anna, schmidt = re.match(r"Dr (\w+) (\w+) sprach", rows[3]).groups()
    assert anna in pii.GIVEN["f", "LATIN"] and f"Frau {schmidt} ging, {anna} {schmidt} kam." in rows[3]
    paul, other = re.search(r"Dr\. (\w+) (\w+), Herr", rows[3]).groups()
    assert rows[3].endswith(f"Herr {other}.") and other != schmidt and paul in pii.GIVEN["m", "LATIN"]
    tom, tall = re.search(r"Mr\. (\w+) (\w+)\.", rows[4]).groups()
    assert rows[4] == f"A long talk with Mr. {tom} {tall}. Long ago. {tom} {tall} said so."
    assert rows[5] == texts[4][1]
    john, peter = re.search(r"Mr\. \w+ (\w+) at", rows[6])[1], re.search(r"Mr\. \w+ (\w+) answered", rows[6])[1]
    assert john != peter and rows[6].startswith(f"{john} wrote") and rows[6].endswith(f"{peter} said.") and "mith" not in rows[6]
    clash = spark.createDataFrame([(1, "Mr. Fox", 7)], "doc_id long, text string, n_name int")
    row = pii.pseudonymized(clash, b"key").first()
    assert row.n_name == 7 and row.n_name_ == 1


def test_texts_full_of_names_take_time_in_proportion():
    start = time.perf_counter()
    text = " ".join(f"Mr. Aa{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} Smith met Smith." for k in range(20000))
    found = pii.detect(text)
    assert len(found) == 40000 and len({f[3] for f in found}) == 676 and time.perf_counter() - start < 20


def test_surrogates_stay_distinct(spark, monkeypatch):
    texts = [(k, f"{c}@x.example.org and {c}1@x.example.org") for k, c in enumerate("abcdefghijklmnop")]
    known = pii.entities(docs_of(spark, texts))
    odd = {(r.kind, r.form): r.attempt for r in pii.exceptions(known, b"key").collect()}
    maker = pii.Surrogates(b"key")
    made = [maker.of(r.kind, r.form, odd.get((r.kind, r.form), 0)) for r in known.collect()]
    assert odd and len(set(made)) == len(made) == 32
    few = pii.pseudonymized(docs_of(spark, texts), b"key").collect()
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    joined = pii.pseudonymized(docs_of(spark, texts), b"key").collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, joined))
    assert set(re.findall(r"\S+@\S+", " ".join(r.text for r in few))) == set(made)


def test_one_letter_mailboxes_of_a_domain_all_get_surrogates(spark):
    forms = [f"{c}@{d}.com" for c in "abcdefghijklmnopqrstuvwxyzé" for d in ("b", "y")]
    known = spark.createDataFrame([("email", f) for f in forms], "kind string, form string")
    odd = {(r.kind, r.form): r.attempt for r in pii.exceptions(known, b"key").collect()}
    maker = pii.Surrogates(b"key")
    made = {maker.of("email", f, odd.get(("email", f), 0)) for f in forms}
    assert len(made) == len(forms) and not made & set(forms) and max(odd.values()) >= pii.WIDER
    late = maker.of("phone", "5551234", pii.WIDER + 1)
    assert len(late) == 9 and pii.written_like("phone", late, "555-1234").startswith(late[:3] + "-")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == docs.columns
        ids, kept = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        if name == "quality classifier":
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert len(good & set(kept)) > 0.9 * len(good & set(ids))
        elif name == "near-dedup":
            assert set(kept) == {k for k, _, _, keep in brute_components(sorted(ids.items())) if keep}
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert set(ids) - set(kept) == {k for k, t in ids.items() if any(i in t for i in items)}
        else:
            assert set(ids) == set(kept)
            assert all(kept[k] == t or base_spans(t) for k, t in ids.items())
        before = after
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()} == set(kept)
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES) and minhash.MISS < 1e-3


@pytest.mark.parametrize("name", ["op2_near_duplicates", "op4_chat_paths", "op5_secret_spans"])
def test_query_equals_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for t in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, cursor = QUERIES[name](spark, DATA), connection.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
