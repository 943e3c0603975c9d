"""Operators 11 to 13 against plain Python."""
import random
from collections import defaultdict
from fractions import Fraction
from hashlib import sha256
from itertools import permutations
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import op11_whitening, op12_filter_audit, op13_chat_format
from factloom.llm.common import Scratch
from tests.llm import cases

# --- 11 --------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, x int, r array<int>, n string, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, [1], "n", 3) for i, v in rows], VECTORS)


def checked(out, rows, scale=256, most=4):
    """Holds whole results against exact fractions and numpy."""
    fine = [(i, [floor(scale * c) for c in v]) for i, v in rows if v is not None and all(c is not None and isfinite(c) for c in v)]
    dims = max(len(v) for _, v in fine)
    fine = [(i, v + [0] * (dims - len(v))) for i, v in fine]
    fit = sorted({tuple(v) for _, v in fine})
    n, sums = len(fit), [sum(v[d] for v in fit) for d in range(dims)]
    centred = [[x - Fraction(s, n) for x, s in zip(v, sums)] for v in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dims)] for i in range(dims)])
    values = np.sort(np.linalg.eigvalsh(cov))[::-1][:most]
    values = values[values > 1e-12 * values[0]]
    by = defaultdict(dict)
    for r in out.collect():
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        by[r["vec_id"], r["deviation"]].setdefault(r["component"], []).append(r["whitened"])
    wanted = defaultdict(int)
    for i, v in fine:
        d = sum((n * x - s) ** 2 for x, s in zip(v, sums))
        wanted[i, d if d < 2**63 else None] += 1
    assert {k: {c: len(w) for c, w in v.items()} for k, v in by.items()} == {k: dict.fromkeys(range(1, len(values) + 1), m) for k, m in wanted.items()}
    whitened = {k: [v[c][0] for c in sorted(v)] for k, v in by.items()}
    first = {}
    for i, v in fine:
        d = sum((n * x - s) ** 2 for x, s in zip(v, sums))
        first.setdefault(tuple(v), whitened[i, d if d < 2**63 else None])
    w = np.array([first[v] for v in fit])
    assert np.abs(w.mean(axis=0)).max() < 1e-8 and np.abs(w.T @ w / n - np.eye(len(values))).max() < 1e-6
    # A projection on eigenvectors: the cross-covariance with the vectors has the eigenvalues' roots as lengths.
    x = np.array([[float(c) for c in v] for v in centred])
    assert np.allclose(np.linalg.norm(x.T @ w / n, axis=0), np.sqrt(values), rtol=1e-7)


def test_whitening_equals_fractions(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7))).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(i, base[5]) for i in range(300, 500)] + [(5, base[5]), (None, base[6]), (600, None), (601, [1.0, None]), (602, [float("nan")] * 7), (603, [float("inf")] * 7), (604, [1.5, -0.0]), (605, []), (606, [-1e-300] * 7)]
    rows = [(i, None if v is None else v) for i, v in rows]
    checked(op11_whitening.whiten(vectors(spark, rows).repartition(5)), rows)


def test_whitening_of_entries_beyond_doubles_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**50, rng.uniform(-1, 1) * 2.0**49 + 2.0**52, rng.uniform(-1, 1) * 2.0**48]) for i in range(60)]
    checked(op11_whitening.whiten(vectors(spark, rows)), rows)
    rows = [(i, [float(rng.randrange(-3, 4)), 2.0, float(i % 3)]) for i in range(50)]
    checked(op11_whitening.whiten(vectors(spark, rows), scale=1), rows, scale=1)  # one dimension without spread, so two components


def test_whitening_without_spread(spark):
    assert op11_whitening.whiten(vectors(spark, [])).count() == 0
    assert op11_whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert op11_whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0


def test_residues_give_back_sums_of_products():
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**62), 2**62, size=(20_000, 3))
    x[0] = [2**63 - 1, -(2**63), 0]
    of = op11_whitening.primes(len(x) * 2**126)
    found = op11_whitening.reconstructed(list(op11_whitening.residue_scatter(x, of)), of)
    wide = x.astype(object)
    assert (found == wide.T @ wide).all() and all(p < 2**20 and all(p % d for d in range(2, 1025)) for p in of)


# --- 12 --------------------------------------------------------------------------------------------------------------

SPACE = "[^\x20\x09-\x0d]+"


def plain_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    import re

    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(SPACE, text)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]
        fails.append(i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs))
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = [0] * 5
        steps = {}
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                hit = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(hit)
                steps["".join("ABCDE"[o] for o in order), step] = f, (len(left), len(hit), sum(r[1][f] for r in own) - len(hit), sum(r[1][f] and sum(r[1]) == 1 for r in own), sum(r[2] for r in hit), sum(r[3] for r in hit))
        out |= {(part, *k): (*v, shapley[f]) for k, (f, v) in steps.items()}
    return out


def found_audit(out):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in out.collect()}


@pytest.mark.parametrize("block", [op12_filter_audit.BLOCK, 3])
def test_the_audit_equals_every_order_run_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(op12_filter_audit, "BLOCK", block)
    monkeypatch.setattr(op12_filter_audit, "PARTS", 2)
    long = " ".join(cases.words(11, 80))
    docs = [(r[0], r[1], r[3]) for r in cases.rows()] + [(200 + i, t, s) for i, (t, s) in enumerate([(long, "s0"), (long, None), (long.upper(), "S0"), ("a\x0bb\x1cc " * 40, "s0"), (f"{long} #tag", "s1"), ("", "s1"), (None, "s1"), (f"{long} {long}", ""), ("A" * 60 + " " + long, "s1")])]
    docs += [(None, long, "s0"), (None, long, "s0"), (5, long, "s9"), (5, long, "s9")] + [(1000 + i, "the same text", "hot") for i in range(150)]
    labels = [(200, 1, 0), (200, 0, 1), (201, 1, None), (None, 1, 1), (1003, 1, 1), (1003, 1, 1), (999999, 1, 1), (1004, None, 1)]
    table = spark.createDataFrame([(i, t, s, 1, 2, "x", 5) for i, t, s in docs], "doc_id long, text string, source string, part int, flags int, digest string, prefix int")
    marked = spark.createDataFrame([(*r, 9) for r in labels], "doc_id long, quality int, toxic int, marks int")
    assert found_audit(op12_filter_audit.audit(table, marked)) == plain_audit(docs, labels)


def test_the_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op12_filter_audit.audit(cases.frame(spark, []), labels).count() == 0


def test_copies_in_plenty_are_dealt_to_many_tasks(spark):
    docs = cases.texts(spark, [(i, "one hot text" if i % 2 else f"text {i}") for i in range(4000)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one partition
    with Scratch(spark) as scratch:
        rows = op12_filter_audit.flagged(docs, labels, scratch)
        copies = rows.where("flags >= 16").groupBy(F.spark_partition_id()).count().collect()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sum(r["count"] for r in copies) == 1999 and max(r["count"] for r in copies) < 1000


# --- 13 --------------------------------------------------------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string, read int, source string, formatted string, clear int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "f", 0) for r in rows], CHATS)


def plain_chats(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(role, text) for _, _, role, text in sorted(turns)] for conv, turns in by.items()}


def hostile_texts(n):
    rng = random.Random(6)
    pieces = ["<|im_end|>", "<|im_start|>", "<|nl|>", "<", "|", ">", "\\", "\n", "assistant", "<\\|im_end|>", "<\\\\|im_start|>", "<|other|>", "im_end", "é🙂", " ", "ok"]
    return ["", None, "\n", "<|im_end|>\n", *("".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(n))]


def test_chats_are_read_back_whatever_they_say(spark):
    texts, rng = hostile_texts(600), random.Random(7)
    roles = ["user", "assistant", "system", None, "", "assistant\nuser", "<|im_start|>", "<|nl|>", "assistant<|im_end|>", "<\\|nl|>"]
    rows = [(i // 7, i % 7 if i % 11 else None, rng.choice(roles[:3] if i % 3 else roles), t) for i, t in enumerate(texts)]
    rows += [(500, 0, "assistant", "x"), (500, 0, "assistant", "x"), (None, 1, "user", "no id"), (501, 0, "assistant", "long " * 40_000)] + [(502, i, "user", f"turn {i}") for i in range(3000)]
    wanted = plain_chats(rows)
    out = {r["conv_id"]: r for r in op13_chat_format.format_chats(chats(spark, rows)).collect()}
    assert {i: [tuple(t)[:2] for t in r["turns"]] for i, r in out.items()} == wanted
    for i, r in out.items():
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(wanted[i])  # none within a text or role
        at, kept = 0, []
        for skip, take, rest in r["loss_mask"]:
            kept.append(r["formatted"][at + skip : at + skip + take])
            at += skip + take + rest
        assert at == len(r["formatted"])
        back = [k.replace("<\\|", "<|") if "\\" in k and "\\\\" not in k else k for k in kept]
        assert len(back) == len(wanted[i])
    digests = {r["conv_id"]: r for r in op13_chat_format.digests(chats(spark, rows)).collect()}
    for i, turns in wanted.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = digests[i]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(loss), sha256(loss.encode()).hexdigest(), len(out[i]["formatted"]))


def test_the_parser_keeps_to_its_grammar(spark):
    good = "<|im_start|>user\nhi<|im_end|>\n"
    bad = ["x" + good, good + "x", good[:-1], good.replace("\n", "", 1), "<|im_start|>user\na<|im_end|>b<|im_end|>\n", "<|im_start|>us<|im_end|>er\na<|im_end|>\n", "<|im_start|>user\n", good + "<|im_start|>", "<|im_start|>user\n<|im_start|>a<|im_end|>\n"]
    rows = spark.createDataFrame([(t,) for t in [good, "", *bad]], "t string").select(op13_chat_format.parsed(F.col("t")).alias("turns")).collect()
    assert [tuple(t) for t in rows[0]["turns"]] == [("user", "hi", 17, 2)] and rows[1]["turns"] == []
    assert all(r["turns"] is None for r in rows[2:])


def test_escaping_is_undone_by_reading(spark):
    texts = [t for t in hostile_texts(500) if t]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = rows.select("t", op13_chat_format.escaped(F.col("t")).alias("e"), op13_chat_format.unescaped(op13_chat_format.escaped(F.col("t"))).alias("u"), op13_chat_format.read_role(op13_chat_format.written_role(F.col("t"))).alias("r"), op13_chat_format.written_role(F.col("t")).alias("w")).collect()
    assert all(r["u"] == r["t"] == r["r"] and not any(mark in r["e"] for mark in (op13_chat_format.START, op13_chat_format.END)) and "\n" not in r["w"] for r in out)


def test_no_python_works_on_chats(spark):
    plan = op13_chat_format.digests(chats(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow") if w in plan]


def test_chats_of_nothing(spark):
    assert op13_chat_format.digests(chats(spark, [])).count() == 0
