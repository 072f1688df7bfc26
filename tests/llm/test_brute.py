"""Whole registered queries against plain loops over all documents."""

import math
import zlib

import numpy as np
import pytest

from ledgerkit.llm import entries, quality, secrets
from ledgerkit.llm.common import table
from ledgerkit.session import settle


def test_quality_scores_against_plain_densities(spark, sf):
    """Class moments, shrinkage, log densities and logistic, with explicit inverses and determinants."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None}
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in docs}
    x = {d: np.array(quality.statistics(t)) for d, t in docs.items()}
    density = []
    for label in (0, 1):
        rows = np.array([x[d] for d, q in labels if q == label and d in docs and not held[d]])
        cov = np.cov(rows.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(len(cov))
        inverse, (_, log_det), mean = np.linalg.inv(cov), np.linalg.slogdet(cov), rows.mean(0)
        density.append(lambda v, i=inverse, m=mean, c=math.log(len(rows)) - log_det / 2: c - (v - m) @ i @ (v - m) / 2)
    found = entries.op1_quality_classifier(spark, sf).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        want = 1 / (1 + math.exp(min(500, max(-500, density[0](x[r["doc_id"]]) - density[1](x[r["doc_id"]])))))
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["held_out"] == held[r["doc_id"]]
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_secret_scan_against_a_loop_over_candidates(spark):
    """Every candidate judged alone; what overlaps is one span."""
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    forest = secrets.train(secrets.weak_labels(settle(secrets.findings(docs))))
    want = set()
    for doc, text in docs.select("doc_id", "text").collect():
        spans = set()
        for start, end in secrets.candidates(text):
            value, left, right = text[start:end], text[max(0, start - secrets.CONTEXT):start], text[end:end + secrets.CONTEXT]
            if forest.scores([value], [left], [right])[0] >= 0.5:
                spans.add((start, end))
        while True:  # merge any two that share a character
            hit = next(((x, y) for x in spans for y in spans if x < y and y[0] < x[1]), None)
            if hit is None:
                break
            spans = (spans - set(hit)) | {(hit[0][0], max(hit[0][1], hit[1][1]))}
        want |= {(doc, *s) for s in spans}
    found = {(r["doc_id"], r["start"], r["end"]) for r in entries.op9_secret_scan(spark, folder).collect()}
    assert found and found == want
