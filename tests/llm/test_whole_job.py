"""What an operator once left undone: short repeated lines and the like."""

import collections

import numpy as np
import pandas as pd

from thermalcube.llm import simhash, toxicity, unit_dedup

SF = "/root/testdata/sf0.001"


def _lines(text):
    return [" ".join(line.lower().split()) for line in (text or "").split("\n") if line.split()]


def test_short_lines_between_unique_ones_go(spark):
    short = "Licensed under the Apache License, Version 2.0."
    texts = [f"first line {i} of text {i * 7}\n{'  ' * i}{short.upper() if i == 2 else short}\nlast line {i * 3} here" for i in range(4)]
    texts.append(f"one more\n{short}\nin between\nOne  more\nat the end {short}")
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in unit_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == texts[0] and got[0].removed == []
    for i in (1, 2, 3):
        assert _lines(got[i].text) == [_lines(texts[i])[0], _lines(texts[i])[2]]
        start, end = got[i].removed[0]
        assert texts[i][start:end].lower() == short.lower()
    assert _lines(got[4].text) == ["one more", "in between", f"at the end {short.lower()}"]


def test_no_line_is_left_twice(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").drop_duplicates(["doc_id", "text"])
    before = collections.Counter(x for t in docs.text for x in _lines(t))
    assert sum(n > 1 and len(x.split()) < unit_dedup.RUN_WORDS for x, n in before.items()) > 5
    got = unit_dedup.remove_repeats(spark.createDataFrame(docs[["doc_id", "text"]])).toPandas()
    whole = dict(zip(docs.doc_id, docs.text))
    left = collections.Counter()
    for r in got.itertuples():
        # Lines cut inside are no whole lines of the input.
        left.update(x for x in _lines(r.text) if x in set(_lines(whole[r.doc_id])))
    assert set(before) >= set(left) and max(left.values()) == 1


def _brute_lines_and_runs(rows, run_words=unit_dedup.RUN_WORDS):
    """Words left of each document: later whole lines go, and runs of repeated words."""
    seen_units, seen_lines, out = set(), set(), {}
    for doc, text in sorted(rows):
        raw = text.encode()
        starts, ends, counts = unit_dedup.units(raw.lower())
        bounds, at = [], 0
        for line in raw.split(b"\n"):
            bounds.append((at, at + len(line)))
            at += len(line) + 1
        line_of = [next(k for k, (a, b) in enumerate(bounds) if a <= s <= b) for s in starts]
        gone_line = []
        for a, b in bounds:
            key = b" ".join(raw[a:b].lower().split())
            gone_line.append(bool(key) and key in seen_lines)
            seen_lines.add(key)
        marked = []
        for a, b, k in zip(starts, ends, line_of):
            key = b" ".join(raw[a:b].lower().split())
            marked.append(key in seen_units or gone_line[k])
            seen_units.add(key)
        left, i = [], 0
        while i < len(marked):
            j = i
            while j < len(marked) and marked[j]:
                j += 1
            run = sum(counts[i:j]) >= run_words
            left += [raw[starts[u] : ends[u]].decode() for u in range(i, j) if not run and not gone_line[line_of[u]]]
            if j < len(marked):
                left.append(raw[starts[j] : ends[j]].decode())
            i = j + 1
        out[doc] = " ".join(" ".join(left).split())
    return out


def test_lines_and_runs_by_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = unit_dedup.remove_repeats(spark.createDataFrame(docs[["doc_id", "text"]])).toPandas()
    want = _brute_lines_and_runs(list(zip(docs.doc_id.tolist(), docs.text.tolist())))
    assert {d: " ".join(t.split()) for d, t in zip(got.doc_id, got.text)} == want


def test_rare_insults_are_landmarks():
    """Of 1,320 toxic texts ten hold one insult, and a word of odds below e ** 2.5 tells the labels apart too."""
    clean = [f"the weather of day {i} is fine and calm" + (" slightly" if i % 6 == 0 else "") for i in range(1320)]
    toxic = [f"the weather of day {i} is fine" + (" zwibbelkopf" if i % 132 == 0 else " slightly quarrelsome") for i in range(1320)]
    chosen = toxicity._choose_landmarks(toxic, clean, toxicity.LANDMARKS)
    assert {"zwibbelkopf", "quarrelsome", "slightly"} <= set(chosen)


def _kept_ids(spark, rows):
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), simhash.SimHash.for_similarity())
    return {r.doc_id for r in kept.collect()}


def test_links_are_decided_by_exact_similarity(spark):
    """Four of five shingles go, ten of thirteen stay, though fingerprints say otherwise of many of either."""
    rows = []
    for i in range(60):
        short = [f"a{i}x{k}" for k in range(9)]
        long = [f"b{i}x{k}" for k in range(69)]
        rows += [(4 * i, " ".join(short)), (4 * i + 1, " ".join(short[:8])), (4 * i + 2, " ".join(long)), (4 * i + 3, " ".join(long[:54]))]
    assert _kept_ids(spark, rows) == {d for d, _ in rows if d % 4 != 1}
    frame = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = simhash.near_duplicates(frame, simhash.SimHash.for_similarity()).collect()
    want = {d: d - 1 if d % 4 == 1 else d for d, _ in rows}
    assert {r.doc_id: r.component_id for r in got} == {**want, None: 0}


def test_components_of_similar_texts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    rng, rows = np.random.default_rng(7), []
    base = [f"w{k}" for k in range(60)]
    for d in range(150):
        text = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 5)):
            text[k] = f"c{rng.integers(0, 3)}"
        rows.append((d, " ".join(text)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert _kept_ids(spark, rows) == set(root) and 1 < len(set(root)) < 140


def test_texts_of_one_repeated_line_differ(spark):
    """Few shingles that made up most of the texts gave them one fingerprint, whatever else they held."""
    rows = [(d, "on and on and on " * 60 + " ".join(f"t{d}x{k}" for k in range(20))) for d in range(6)]
    assert _kept_ids(spark, rows) == set(range(6))


def test_the_sample_to_learn_from_is_bounded(spark, monkeypatch):
    """Repeated labels do not use up the sample, and an id with many texts gives one."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.extend(zip(texts, labels)))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(d, f"own {d}") for d in range(2, 6)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 20 + [(2, 1), (3, 1), (4, 0), (5, 0)], "doc_id long, toxic int")
    toxicity.fit_on(docs, labels, per_label=3)
    assert sorted(y for _, y in seen) == [0, 0, 1, 1, 1] and {"own 2", "own 3", "own 4", "own 5"} < {t for t, _ in seen}
