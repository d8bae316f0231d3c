"""The pipeline's stages against plain versions of them, written for this test, on a whole small table."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from attesta.llm import quality
from tests.llm.test_operators import brute_near, brute_scan

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def plain_quality(text):
    """Kept text, or None if the document goes."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {i + k for i in range(len(ws) - 2) if triples[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    if len(ws) < 50 or 100 * len(covered) > 50 * len(ws):
        return None
    kept, lost = [], 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        symbols = sum(line.count(c) for c in "#*$%&|<>") + line.count("!!")
        low = line.lower()
        bad = own and (
            5 * symbols > len(own) or (len(own) >= 10 and not set(line) & set(".!?;:…。！？")) or 3 * sum(line.count(c) for c in "|»›•") > len(own) or low.strip(SPACE) in quality.NAVIGATION or any(b in low for b in quality.BOILERPLATE)
        )
        if bad:
            lost += sum(map(len, own))
        else:
            kept.append(line)
    return None if 100 * lost > 30 * sum(map(len, ws)) else "\n".join(kept)


def plain_redact(text):
    """Base spans masked: what overlaps or touches is one mask."""
    hit = [False] * len(text)
    for span in filter(None, brute_scan(text).split(",")):
        _, a, b = span.split(":")
        hit[int(a) : int(b)] = [True] * (int(b) - int(a))
    out, was = [], False
    for c, h in zip(text, hit, strict=True):
        if h and not was:
            out.append("[SECRET]")
        elif not h:
            out.append(c)
        was = h
    return "".join(out)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = set(docs.columns)
    before = {r.doc_id: r.text for r in docs.collect()}
    out, seen = docs, {}
    for name, stage in p.STAGES:
        out = p.spill(stage(spark, out, SF), name)
        seen[name] = out.collect()
        if name != "packing":
            assert set(out.columns) == columns
    kept = {i: t for i, x in before.items() if (t := plain_quality(x)) is not None}
    assert {r.doc_id: r.text for r in seen["quality"]} == kept
    near = brute_near(list(kept.items()))
    alone = {i for i, (c, _) in near.items() if c == i}
    assert {r.doc_id for r in seen["near_duplicates"]} == alone
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in alone if not any(t in " ".join(kept[i].split()) for t in items)}
    assert {r.doc_id for r in seen["decontamination"]} <= clean
    assert len(clean) - len(seen["decontamination"]) <= 1  # a template may hold where the plain text doesn't
    assert {r.doc_id for r in seen["secrets"]} == {r.doc_id for r in seen["decontamination"]}
    masked = {r.doc_id: r.text for r in seen["secrets"]}
    assert all(masked[i] == plain_redact(kept[i]) for i in masked if not re.search(r"%[0-9A-Fa-f]{2}|\\[ux]|&#|[A-Za-z0-9+/_-]{16}|[0-9A-Fa-f]{24}", kept[i]))
    assert all(brute_scan(t) == "" for t in masked.values())
    assert all(r.n_chars == len(r.text) for r in seen["secrets"])
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {i: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
    pieces, bins = defaultdict(int), defaultdict(list)
    for r in seen["packing"]:
        pieces[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert dict(pieces) == n
    for b in bins.values():
        ends = np.cumsum([0] + [length for _, length in sorted(b)])
        assert [o for o, _ in sorted(b)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_empty_table(spark):
    """No documents, and documents that all go, give an empty table of the last stage's columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for some in (docs.limit(0), docs.limit(3).withColumn("text", p_text("too short"))):
        for name, stage in p.STAGES:
            some = p.spill(stage(spark, some, SF), name)
        assert some.count() == 0 and "sequence_id" in some.columns


def p_text(t):
    from pyspark.sql import functions as F

    return F.lit(t)
