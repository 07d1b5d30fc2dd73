import random
import re
from collections import Counter, defaultdict

import pytest

from jobtide.llm import colloc
from tests.llm.helpers import LOWER


def brute(rows, longest, least, top):
    """Expected rows, by counting every phrase."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {
            q for p, a in candidates.items() for m in range(2, len(p)) for q in (p[i:i + m] for i in range(len(p) - m + 1))
            if 100 * a >= 100 * counts[q]
        }
        scored = []
        for p, a in candidates.items():
            if p not in inner:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def texts(rnd, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", " x", "ÀB", "A", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for _ in range(n):
        w = []
        for _ in range(rnd.randint(0, 30)):
            w += rnd.choice([["fixed", "phrase", "of", "five", "words"], ["New", "york"], rnd.choices(vocabulary, weights, k=3)])
            w.append(rnd.choice(["", "", "", ".", ",", "\n", "\t", "?!", "\r\n", "new york"]))
        rows.append((" ".join(w), rnd.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("ranked,tile,dense,held", [(1 << 16, 1024, 1 << 14, 1 << 20), (1 << 16, 4, 2, 1 << 20), (20, 8, 3, 50), (1, 1024, 1, 10), (50, 16, 1, 30)])
def test_equals_brute_force(spark, monkeypatch, ranked, tile, dense, held):
    for name, value in (("TILE", tile), ("DENSE", dense), ("HELD", held)):
        monkeypatch.setattr(colloc, name, value)
    rows = texts(random.Random(ranked + tile), 120) + [(None, "en"), ("", "fr"), ("One", "it"), (" . ", "es")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "text string, lang string, phrase string, f int, id string").repartition(3)
    got = [tuple(r) for r in colloc.collocations(df, least=6, top=40, ranked=ranked).collect()]
    assert set(got) == brute(rows, 5, 6, 40) and len(got) == len(set(got))


def test_tiles_count_like_a_counter(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(4)
    for tile, dense, tiles_kept, held in ((4, 1, 3, 5), (8, 10, 2, 40), (1024, 1 << 14, 12, 1 << 20)):
        for name, value in (("TILE", tile), ("DENSE", dense), ("DENSE_TILES", tiles_kept), ("HELD", held)):
            monkeypatch.setattr(colloc, name, value)
        tiles, want, got = colloc.Tiles(), Counter(), Counter()

        def take(drained):
            for r, c, n in zip(*(x.tolist() for x in drained)):
                got[r, c] += n

        for _ in range(20):
            row, col = (rnd.zipf(1.4, 300) % 70 for _ in range(2))
            want.update(zip(row.tolist(), col.tolist()))
            tiles.add(row, col)
            assert len(tiles.dense) <= tiles_kept
            if tiles.full():
                take(tiles.drain(False))
        take(tiles.drain(True))
        assert got == want


def test_products_beyond_64_bits(spark):
    """Scores are exact where 1000 * a * n passes 2**63."""
    from pyspark.sql import functions as F

    a, n, left, right = 10**9 + 7, 10**13 + 9, 3 * 10**9 + 1, 10**9 + 9
    exact = "CAST({} AS DECIMAL(19, 0))"
    score = F.expr(f"{exact.format('1000 * f')} * {exact.format('n')} div ({exact.format('l')} * {exact.format('r')})")
    row = spark.createDataFrame([(a, n, left, right)], "f long, n long, l long, r long").select(score.alias("s")).first()
    assert row["s"] == 1000 * a * n // (left * right)


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert colloc.collocations(df).count() == 0


def test_one_long_text(spark):
    rows = [(" ".join(["alpha beta gamma"] * 60_000) + ". " + "delta " * 70_000, "en"), ("alpha beta", "en")]
    got = {tuple(r) for r in colloc.collocations(spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert got == brute(rows, 5, 100, 2000)
