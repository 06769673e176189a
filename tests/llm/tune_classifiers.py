"""Chooses the classifiers' settings by cross-validation inside their training rows.

``python tests/llm/tune_classifiers.py FOLDER`` reads documents and labels of FOLDER. Rows of the
contracts' held-out folds are dropped before anything else is read from them.
"""

import glob
import itertools
import os
import sys
import zlib

import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from boscage.llm import hier_langid, ngram_quality, toxic_segments  # noqa: E402

FOLDS = 3


def table(folder, name, columns):
    path = f"{folder}/{name}.parquet"
    return pd.concat([pd.read_parquet(f, columns=columns) for f in (sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path])])


def training(folder, parts, held, label=None, rows=6000):
    """Training rows with ``part``, the fold of the cross-validation: equal texts share one."""
    code = lambda i: zlib.crc32(str(i).encode())
    d = table(folder, "documents", ["doc_id", "text", "lang"]).dropna(subset=["doc_id", "text"])
    d = d[d.doc_id.map(code) % parts != held]
    if label:
        lab = table(folder, "labels", ["doc_id", label]).dropna()
        d = d.merge(lab[lab[label].isin([0, 1])], on="doc_id")
    d = d.sort_values("doc_id", key=lambda c: c.map(lambda i: code(f"tune{i}"))).head(rows).reset_index(drop=True)
    d["part"] = d.text.map(lambda t: zlib.crc32(t.encode()) % FOLDS)
    return d


def auc(score, y):
    rank = pd.Series(score).rank().to_numpy()
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def quality(folder):
    d = training(folder, 5, 0, "quality")
    rows, y = [ngram_quality.features(t) for t in d.text], d.quality.to_numpy(int)
    for alpha, l1, l2 in itertools.product((0.3, 1.0), (0.005, 0.02, 0.08), (0.05,)):
        score = np.zeros(len(d))
        for k in range(FOLDS):
            fit, test = np.flatnonzero(d.part != k), np.flatnonzero(d.part == k)
            m = ngram_quality.Ftrl.fit([rows[i] for i in fit], y[fit].tolist(), alpha=alpha, l1=l1, l2=l2)
            score[test] = [m.score(*rows[i]) for i in test]
        print(f"quality alpha={alpha} l1={l1} l2={l2}: auc {auc(score, y):.4f}, good refused {((score < 0.3) & (y == 1)).sum()} of {y.sum()}, bad accepted {((score >= 0.3) & (y == 0)).sum()} of {(1 - y).sum()}", flush=True)


def toxicity(folder):
    d = training(folder, 3, 1, "toxic", 12_000)
    y = d.toxic.to_numpy(int)
    places = [toxic_segments.tokens(t)[0] for t in d.text]
    size = 1 << toxic_segments.BITS
    for prior, caution, drift in itertools.product((1000.0, 3000.0, 10_000.0), (1.0, 2.0, 3.0), (0.5, 1.0)):
        toxic_segments.PRIOR, toxic_segments.CAUTION, toxic_segments.DRIFT = prior, caution, drift
        score = np.zeros(len(d))
        for k in range(FOLDS):
            sums, tokens = np.zeros((2, size)), np.zeros(size)
            for i in np.flatnonzero(d.part != k):
                sums[y[i]][np.unique(places[i])] += 1
            token = toxic_segments.log_odds(sums[1], sums[0])
            for i in np.flatnonzero((d.part != k) & (y == 0)):
                p = places[i]
                np.add.at(tokens, np.where(token[p[:, 0]] >= token[p[:, 1]], p[:, 0], p[:, 1]), 1)
            m = toxic_segments.Toxicity(token, toxic_segments.karlin_lambda(token.astype(float), tokens), 0.0, -20.0, 0.0)
            fit = np.flatnonzero(d.part != k)[: toxic_segments.CALIBRATION_ROWS]
            toxic_segments.calibrate(m, [places[i] for i in fit], y[fit].astype(float))
            for i in np.flatnonzero(d.part == k):
                score[i] = m.probability(m.evidence(places[i])[0])
        print(f"toxicity prior={prior} caution={caution} drift={drift}: auc {auc(score, y):.4f}, caught {((score >= 0.7) & (y == 1)).sum()} of {y.sum()}, clean taken {((score >= 0.7) & (y == 0)).sum()} of {(1 - y).sum()}", flush=True)


def language(folder):
    d = training(folder, 4, 2, None, 9000).dropna(subset=["lang"])
    d = d[d.text.map(hier_langid.has_letter)].reset_index(drop=True)
    for lam, epochs in itertools.product((1e-5, 1e-4, 1e-3), (4,)):
        hier_langid.LAMBDA, hier_langid.EPOCHS = lam, epochs
        right = low = 0
        for k in range(FOLDS):
            fit, test = d[d.part != k].head(2400), d[d.part == k].head(1000)
            m = hier_langid.LangModel.fit(fit.text.tolist(), fit.lang.tolist())
            got = [m.predict(t) for t in test.text]
            right += sum(g[0] == x for g, x in zip(got, test.lang))
            low += sum(g[0] == x and g[1] < 0.3 for g, x in zip(got, test.lang))
        print(f"language lambda={lam} epochs={epochs}: {right} of {3 * 1000} right, {low} of them below 0.3", flush=True)


if __name__ == "__main__":
    for one in (language, quality, toxicity):
        one(sys.argv[1])
