import hashlib
import random
import time
import re

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import op1_substring_dedup, op2_pii, op3_near_dedup, op6_lm_score, op8_fingerprint, op9_quality, op10_language
from tests.llm import cases

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def edit(words, at, rng):
    out = list(words)
    for i in at:
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(4)
    pairs = [(i, t) for i, (_, t, *_) in enumerate(cases.rows()[:-2])]
    for k in range(12):  # chains of edits, so that some groups hang together only through others
        w = cases.words(100 + k, 60 + 5 * k)
        for step in range(6):
            w = edit(w, rng.sample(range(len(w)), 3), rng)
            pairs.append((1000 + 10 * k + step, " ".join(w)))
    rng.shuffle(pairs)
    for size in (2, 5):
        sets = {i: shingles(t, size) for i, t in pairs}
        root = {i: i for i in sets}
        ids = sorted(sets)
        changed = True
        links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        while changed:
            changed = False
            for a, b in links:
                low = min(root[a], root[b])
                if root[a] != low or root[b] != low:
                    root[a] = root[b] = low
                    changed = True
        out = {r["doc_id"]: r for r in op3_near_dedup.groups(cases.texts(spark, pairs), size, 80).collect()}
        assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in out.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def components_of(sets):
    """The least id that each id reaches over links at 0.8, by comparing all pairs."""
    root, ids = {i: i for i in sets}, sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = cases.words(50, 150)
    pairs = [(i, " ".join(edit(base, rng.sample(range(150), rng.randrange(2, 14)), rng))) for i in range(160)]
    monkeypatch.setattr(op3_near_dedup, "BLOCK", 16)
    monkeypatch.setattr(op3_near_dedup, "STAR", 5)
    out = {r["doc_id"]: r["component_id"] for r in op3_near_dedup.groups(cases.texts(spark, pairs), 2, 80).collect()}
    wanted = components_of({i: shingles(t, 2) for i, t in pairs})
    assert out == wanted and 1 < len(set(wanted.values())) < 160


def test_a_row_without_an_id_links_others(spark):
    words = cases.words(51, 100)
    rng = random.Random(2)
    middle = edit(words, [40, 41], rng)
    pairs = [(3, " ".join(words)), (None, " ".join(middle)), (9, " ".join(edit(middle, [60, 61], rng))), (None, "apart from all others")]
    out = {r["doc_id"]: r for r in op3_near_dedup.groups(cases.texts(spark, pairs[:3]), 5, 84).collect()}
    assert {r["component_id"] for r in out.values()} == {3} and out[3]["kept"] and not out[9]["kept"] and not out[None]["kept"]
    rows = op3_near_dedup.groups(cases.texts(spark, pairs[3:]), 5, 84).collect()
    assert rows[0]["component_id"] is None and rows[0]["kept"]


def test_near_groups_of_awkward_rows(spark):
    out = op3_near_dedup.groups(cases.frame(spark), 5, 80).collect()
    assert len(out) == len(cases.rows())
    by = {r["doc_id"]: r for r in out}
    assert by[4]["component_id"] == 1 and by[7]["component_id"] == 1 and not by[7]["kept"]
    assert by[10]["n_shingles"] == 0 and by[10]["kept"] and by[None]["kept"]
    assert op3_near_dedup.groups(cases.frame(spark, []), 5, 80).count() == 0


def test_pruning_keeps_true_pairs():
    assert op3_near_dedup.least_matches(24, 80, 1e-7) < 24 * 0.6
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 16, (300, 240)).astype(np.uint16)
    right = np.where(rng.random((300, 240)) < 0.82, left, rng.integers(0, 1 << 16, (300, 240))).astype(np.uint16)
    assert len(op3_near_dedup.survive(left, right, 80)) == 300
    assert len(op3_near_dedup.survive(left, np.roll(right, 1, axis=0), 80)) == 0


def test_repeated_passages_go_from_all_but_their_holder(spark):
    out = {r["doc_id"]: r["text"] for r in op1_substring_dedup.without_repeats(cases.frame(spark)).where("doc_id is not null").collect()}
    given = {i: t for i, t, *_ in cases.rows() if i is not None}
    passage = cases.words(2, 70)
    middle = " ".join(passage[20:50])
    assert middle in out[25] and middle not in out[28]
    assert " ".join(cases.words(5, 25)) in out[28] and " ".join(cases.words(6, 60)[10:]) in out[28]
    assert out[7] == "" and out[4].strip() == "changed"
    assert out[28] == given[28].replace(" ".join(passage), "") or len(out[28]) <= len(given[28]) - len(" ".join(passage))
    for i in (1, 10, 13, 16, 19, 22, 25, 31, 34, 37, 40, 43, 46):
        assert out[i] == given[i]
    found = {r["doc_id"] for r in op1_substring_dedup.summary(cases.frame(spark)).collect()}
    assert found == {1, 4, 7, 25, 28}
    assert op1_substring_dedup.summary(cases.frame(spark, [])).count() == 0
    assert op1_substring_dedup.without_repeats(cases.frame(spark)).columns == cases.frame(spark).columns


def test_repeated_passages_of_a_short_period_are_found(spark):
    rng = random.Random(5)
    pairs = [(i, " ".join(cases.words(700 + i, 60 + 7 * i) + ["entüber"] * (90 + 11 * i) + cases.words(800 + i, 80))) for i in range(4)]
    out = {r["doc_id"]: r for r in op1_substring_dedup.summary(cases.texts(spark, pairs)).collect()}
    assert set(out) == {0, 1, 2, 3} and out[0]["removed_chars"] == 0 and all(out[i]["removed_chars"] > 500 for i in (1, 2, 3)) and rng


def test_repeated_passages_equal_brute_force(spark):
    """Every text that shares 51 words side by side with another is found, and none that shares no 40."""
    rng = random.Random(11)
    stock = [cases.words(900 + k, rng.randrange(30, 90)) for k in range(40)]
    pairs = [(i, " ".join(cases.words(2000 + i, rng.randrange(5, 120)) + rng.choice(stock) + cases.words(4000 + i, rng.randrange(5, 120)))) for i in range(120)]

    def sharing(k):
        where = {}
        for i, t in pairs:
            w = t.split()
            for j in range(len(w) - k + 1):
                where.setdefault(tuple(w[j : j + k]), set()).add(i)
        return set().union(*(v for v in where.values() if len(v) > 1))

    found = {r["doc_id"] for r in op1_substring_dedup.summary(cases.texts(spark, pairs)).collect()}
    assert sharing(51) <= found <= sharing(40)


def test_chunks_resist_insertions():
    text = " ".join(cases.words(9, 2000))
    before = set(op1_substring_dedup.chunks([text])[0].tolist())
    after = set(op1_substring_dedup.chunks([text[:3000] + "inserted" + text[3000:]])[0].tolist())
    assert len(before - after) <= 4
    digests, sizes, at = op1_substring_dedup.chunks(["", text, "", "ab"])
    assert at.tolist() == [0, 0, len(sizes) - 1, len(sizes) - 1, len(sizes)] and sizes.sum() == len(text) + 2


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for alphabet in ("0123456789 .-()+@a%", "01.@ab ", "12 -+("):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
            assert op2_pii.base_spans(text) == plain_spans(text), text


def test_personal_data_of_awkward_rows_and_additions(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(cases.rows())]
    rows += [(100 + i, f"call +1 (514) 555-{1000 + i} now, card 4111111111111111 ok, mail a{i}@b.com") for i in range(60)]
    rows += [(200, "a +1 (514) 555-8389 23.102.220.119 b"), (201, "x 7536784127813050 4845168114407329 y"), (202, "long 1234567890123456 number"), (203, f"here token='{'0a1b2c3d4e' * 4}' ends"), (204, "see https://example.org/a/long/path/of/words and title=introduction")]
    rows += [(300 + i, f'with token = "{hashlib.sha1(bytes([i])).hexdigest()}" set') for i in range(40)]
    docs = cases.texts(spark, rows)
    out = {r["doc_id"]: r for r in op2_pii.detect(docs).collect()}
    for i, text in rows:
        base = plain_spans(text or "")
        spelled = ",".join(f"{k}:{a}:{b}" for k in op2_pii.KINDS for a, b in base[k])
        assert out[i]["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in op2_pii.KINDS] == [len(base[k]) for k in op2_pii.KINDS]
        assert set(filter(None, spelled.split(","))) <= set(out[i]["spans"].split(","))
    assert out[203]["spans"] == "secret:12:52" and out[203]["n_secret"] == 1 and out[204]["spans"] == ""
    assert "phone:2:19" in out[200]["spans"] and "card:19:35" in out[201]["spans"] and out[202]["spans"] == ""
    text = {r["doc_id"]: r["text"] for r in op2_pii.redact(docs).collect()}
    assert text[200] == "a [PHONE] [IP] b" and text[201] == "x 7536784127813050 [CARD] y" and text[3] is None
    assert op2_pii.detect(cases.frame(spark, [])).count() == 0


def test_long_numbers_and_texts_are_searched():
    for text in ("0" * 5000 + "1.2.3.4", "1." * 3000, "9" * 20000, "+1 " * 2000, "a@b." * 500, "x" * 5000 + "=" + "y" * 5000, "ab:" * 3000):
        found = op2_pii.base_spans(text)
        if text[0] not in "09":
            assert found == plain_spans(text)
        op2_pii.candidates(text, found)
    assert op2_pii.base_spans("0" * 5000 + "1.2.3.4")["ip"] == [(0, 5007)]


def test_texts_of_many_spans_take_time_in_proportion():
    for one in ("call +1 514 555 8389, ", "4111 1111 1111 1111 x ", "a at b dot com, ", "key=abcDEF123456789xyz ", "ring 514-555-8389 or "):
        text = one * 20_000
        began = time.process_time()
        found = op2_pii.base_spans(text)
        more = op2_pii.candidates(text, found)
        assert time.process_time() - began < 4 and sum(map(len, found.values())) + len(more) >= 0


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.95, truth, ~truth) * 2 - 1
    poor = np.where(rng.random(4000) < 0.6, truth, ~truth) * 2 - 1
    posterior, table = op2_pii.reliabilities(np.stack((good, good * (rng.random(4000) < 0.8), poor), axis=1).astype(int), np.ones(4000))
    assert ((posterior > 0.5) == truth).mean() > 0.93 and table[0, 1, 2] > table[2, 1, 2]


def test_fingerprints(spark):
    docs = cases.frame(spark)
    out = op8_fingerprint.edited(docs).collect()
    assert len(out) == len(cases.rows())
    given = sorted(((i, t or "") for i, t, *_ in cases.rows()), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    wanted = []
    for k, (i, t) in enumerate(given):
        after = given[(k + 1) % len(given)][1]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = shingles(t, 5), shingles(e, 5), shingles(after, 5)
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        wanted.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), near(a, b), near(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in out), key=key)
    for g, w in zip(got, sorted(wanted, key=key), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 0.25 and abs(g[4] - w[4]) < 0.25
    by = {r["doc_id"]: r["fingerprint"] for r in out}
    assert by[1] == by[7] and by[10] == by[13] != by[16]
    assert op8_fingerprint.edited(cases.frame(spark, [])).count() == 0
    wanted = components_of({i: shingles(t or "", 5) for i, t, *_ in cases.rows() if i is not None})
    assert wanted[7] == wanted[4] == 1 and all(r["near_class"] == wanted.get(r["doc_id"]) for r in out)


def test_every_document_finds_its_class_in_its_range(spark):
    base = [cases.words(seed, 60) for seed in range(40)]
    given = [(k, " ".join(base[k % 40][: 60 - k // 40])) for k in range(200)]
    out = {r["doc_id"]: r["near_class"] for r in op8_fingerprint.edited(cases.texts(spark, given)).collect()}
    assert out == components_of({k: shingles(t, 5) for k, t in given})


def test_cross_entropy_difference_equals_brute_force(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(cases.rows())] + [(100 + i, "the cat sat on the mat and the dog") for i in range(20)]
    docs = cases.texts(spark, rows)
    target = spark.createDataFrame([(100 + i,) for i in range(20)] + [(None,)], "doc_id long")
    out = {r["doc_id"]: r for r in op6_lm_score.difference(docs, target).collect()}
    letters = [ord(c) for c in "etaoinshrdluc"]
    count = {}
    for _, t in rows:
        for c in (t or "").lower():
            if c.isalpha():
                count[ord(c)] = count.get(ord(c), 0) + 1
    letters = sorted(count, key=lambda c: (-count[c], c))[: op6_lm_score.SYMBOLS]
    symbols, base = op6_lm_score.table_of(letters), op6_lm_score.FIXED + op6_lm_score.SYMBOLS

    def tokens(t):
        return [0] * 3 + [int(symbols[ord(c)]) for c in t.lower()]

    def model(texts):
        n = {}
        for t in texts:
            row = tokens(t)
            for i in range(3, len(row)):
                for k in range(4):
                    n[tuple(row[i - k : i + 1])] = n.get(tuple(row[i - k : i + 1]), 0) + 1
                    n[(*row[i - k : i], None)] = n.get((*row[i - k : i], None), 0) + 1

        def p(context, s):
            lower = p(context[1:], s) if context else 1 / base
            return (n.get((*context, s), 0) + 4 * lower) / (n.get((*context, None), 0) + 4)

        def p_all(row, i):
            q = 1 / base
            for k in range(4):
                context = tuple(row[i - k : i])
                q = (n.get((*context, row[i]), 0) + 4 * q) / (n.get((*context, None), 0) + 4)
            return q

        return p_all

    near, far = model([t for i, t in rows if i >= 100]), model([t or "" for _, t in rows])
    for i, t in rows:
        if not t or len(t) > 4000:
            continue
        row = tokens(t)
        a, b = (-sum(np.log(m(row, j)) for j in range(3, len(row))) / (len(row) - 3) for m in (near, far))
        assert abs(out[i]["target_loss"] - a) < 1e-4 and abs(out[i]["background_loss"] - b) < 1e-4 and abs(out[i]["score"] - (a - b)) < 2e-4
    assert out[100]["score"] < out[0]["score"] and out[4]["n_tokens"] == 0
    assert op6_lm_score.difference(cases.frame(spark, []), target).count() == 0


def test_cross_entropy_difference_tells_all_code_points_apart(spark):
    scripts = ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyz"]
    rng = random.Random(9)
    filler = [(i, " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(60))) for i, s in enumerate(scripts * 3)]
    pairs = [(100, "語彙"), (101, "語彙"), (102, "別物"), (103, "1111 +"), (104, "2222 +"), (105, "1111 ="), (106, "1111 +")]
    target = spark.createDataFrame([(100,), (103,)], "doc_id long")
    out = {r["doc_id"]: r for r in op6_lm_score.difference(cases.texts(spark, filler + pairs), target).collect()}
    assert out[100]["score"] == out[101]["score"] and out[103]["score"] == out[106]["score"]
    assert out[102]["score"] > out[100]["score"] + 0.1 and min(out[104]["score"], out[105]["score"]) > out[103]["score"] + 0.1


def test_cross_entropy_difference_is_the_same_in_many_blocks(spark, monkeypatch):
    docs, target = cases.frame(spark), spark.createDataFrame([(1,), (10,), (22,)], "doc_id long")
    seen = lambda: sorted((r["doc_id"] or -1, r["n_tokens"], round(r["target_loss"] or 0, 9), round(r["score"] or 0, 9)) for r in op6_lm_score.difference(docs, target).collect())
    one = seen()
    monkeypatch.setattr(op6_lm_score, "BLOCK", 3000)
    assert seen() == one and len(one) == len(cases.rows())


def test_quality_on_held_out_documents(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        lines = [" ".join(cases.words(1000 + 9 * i + k, 12)).capitalize() + "." for k in range(5)]
        bad = i % 4 == 0
        if bad:
            lines[1:] = [" ".join(w.upper() + "!!" for w in line.split()) for line in lines[1:]]
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    docs += [(1000 + i, t) for i, (_, t, *_) in enumerate(cases.rows())]
    frame, marked = cases.texts(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["quality_score"] for r in op9_quality.scored(frame, marked, F.col("doc_id") % 5 != 0).collect()}
    assert len(out) == len(docs) and all(0 <= s <= 1 for s in out.values())
    held = [i for i in range(400) if i % 5 == 0]
    assert sum((out[i] >= 0.3) == (i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert rng and op9_quality.scored(frame, marked.limit(0)).where("quality_score <> 0.5").count() == 0
    assert op9_quality.scored(cases.frame(spark, []), marked).count() == 0


def test_a_quality_score_is_a_function_of_its_text(spark):
    rng = np.random.default_rng(5)
    texts = [t or "" for _, t, *_ in cases.rows()] + ["\n".join(" ".join(cases.words(50 * k + j, 9)) + ("!!" if j % 3 else ".") for j in range(1 + 40 * k)) for k in range(9)]
    field = op9_quality.Field(rng.normal(size=39), rng.random(39) + 0.5, rng.normal(size=40), rng.normal(size=(2, 2)), (3.0, -1.0), 0.6)
    alone = [float(op9_quality.score([t], field)[0]) for t in texts]
    assert op9_quality.score(texts, field).tolist() == alone and op9_quality.score(texts[::-1], field).tolist() == alone[::-1]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for dealt in (rows.coalesce(1), rows.repartition(7)):
        assert {r["i"]: r["s"] for r in dealt.select("i", op9_quality.quality(field, spark).alias("s")).collect()} == dict(enumerate(alone))


def test_chain_marginals_equal_brute_force(monkeypatch):
    monkeypatch.setattr(op9_quality, "SEGMENT", 2)
    rng = np.random.default_rng(3)
    at = np.array([0, 0, 3, 4, 9])
    score, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    odds, expected = op9_quality.marginals(score, moves, at)
    total = np.zeros((2, 2))
    for a, b in zip(at, at[1:], strict=False):
        n = b - a
        weights, labels = [], []
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            weights.append(np.exp(sum(score[a + i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1))))
            labels.append(y)
        weights = np.array(weights) / np.sum(weights)
        for i in range(n):
            p = sum(w for w, y in zip(weights, labels, strict=True) if y[i])
            assert abs(odds[a + i] - np.log(p / (1 - p))) < 1e-9
        for w, y in zip(weights, labels, strict=True):
            for i in range(n - 1):
                total[y[i], y[i + 1]] += w
    assert np.allclose(total, expected)


def test_languages_on_held_out_documents(spark):
    stock = {"en": "the of and to in is that it for was on with as", "de": "der die und das ist nicht mit von auf für ein eine", "fr": "le la les des est une que dans pour qui sur avec"}
    rng = random.Random(7)
    rows = []
    for i in range(600):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(stock[lang].split()) for _ in range(40)), lang, "s", 0, *[None] * 11))
    docs = cases.frame(spark, rows + [(1000 + i, *r[1:]) for i, r in enumerate(cases.rows())])
    out = {r["doc_id"]: r["language"] for r in op10_language.identify(docs, (F.col("doc_id") < 600) & (F.col("doc_id") % 4 != 2)).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(out[r[0]]["lang_pred"] == r[2] for r in held) >= 0.99 * len(held)
    assert sum(out[r[0]]["accepted"] for r in held) >= 0.99 * len(held)
    for i in (3, 4, 7):
        assert out[1000 + i]["lang_pred"] == "und" and out[1000 + i]["score"] == 0 and not out[1000 + i]["accepted"]
    assert not out[1011]["accepted"] and all(0 <= v["score"] <= 1 for v in out.values())
    assert op10_language.identify(cases.frame(spark, [])).count() == 0
    nothing = op10_language.identify(docs, F.lit(False)).select("language.lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]


def test_kneser_ney_is_a_distribution():
    rows = [np.array([1 << 48 | 2 << 32 | 3 << 16 | 1, 2 << 48 | 3 << 32 | 1 << 16 | 2, 1 << 48 | 2 << 32 | 3 << 16 | 2], np.uint64)]
    unigram, levels = op10_language.kneser_ney(rows, 5)
    assert abs(unigram.sum() - 1) < 1e-12
    union, p, _, _ = levels[-1]
    own = (union >> np.uint64(16)) == (1 << 32 | 2 << 16 | 3)
    assert 0.5 < p[own].sum() < 1
