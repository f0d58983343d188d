import random
import re

from twinbuild.llm.license_scan import PHRASES, TEMPLATES, build_index, held_share, license_digest, matches, places, scan_licenses, slack, words_of


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(label, k) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for _, k in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in found}))


def test_base_places_and_labels(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "Cc-By-NC cc by nc cc by cc by nc"), (-2, "x under the MIT license, Apache License (Version 2) é"), (-3, "under the mit"), (-4, "GNU General Public License")], "doc_id long, text string")
    docs = docs.unionByName(extra).unionByName(odd.where("doc_id <> 5").selectExpr("doc_id + 10000 doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = license_digest(scan_licenses(docs)).collect()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])
        own = set(filter(None, r["labels"].split(",")))
        assert set(filter(None, r["base_labels"].split(","))) <= own and 0 <= r["score"] <= 1 and list(filter(None, r["labels"].split(","))) == sorted(own)
        if r["doc_id"] >= 0 and r["doc_id"] < 10000:
            text = texts[r["doc_id"]]
            assert ("gpl-3" in own) == ("GNU General Public License, version 3" in text) and ("mit" in own) == ("MIT License" in text)
            assert ("cc-by-nc" in own) == ("CC BY-NC" in text) and bool(own) == bool(re.search("GNU General|MIT License|Apache License|CC BY-NC", text))


def test_relative_positions_and_key_phrases():
    index = build_index({b"the": 90, b"license": 5}, 100)
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    assert [m[:2] for m in matches(index, words_of(("a b c " + notice).encode()))] == [("mit", 3)]
    assert matches(index, words_of(" ".join(reversed(notice.split())).encode())) == []
    assert matches(index, words_of(notice.replace("without", "with no").encode())) == []
    assert matches(index, []) == []


def brute_matches(index, words, share=0.7):
    """The best share of each template over every start, without index, candidates or look-ups."""
    where = {}
    for at, w in enumerate(words):
        where.setdefault(w, []).append(at)
    best = {}
    for k, (label, own, phrases) in enumerate(index.templates):
        for start in range(-len(own), len(words)):
            stretch = words[max(start, 0) : max(start + len(own) + slack(len(own)), 0)]
            if all(places(stretch, p) for p in phrases) and (score := held_share(index, k, where, start)) >= share:
                best[label, len(own)] = max(best.get((label, len(own)), 0), score)
    return best


def test_matches_are_those_of_every_start():
    rng = random.Random(8)
    counts = {w: rng.randint(0, 60) for t in TEMPLATES for w in set(words_of(t.text.encode()))} | {b"the": 95, b"of": 90, b"to": 90, b"is": 80}
    index = build_index(counts, 100)
    filler = [*counts, *(f"w{k}".encode() for k in range(300))]
    seen = set()
    for k, t in enumerate(TEMPLATES):
        for other in (None, TEMPLATES[(k * 7 + 3) % len(TEMPLATES)]):
            words = rng.choices(filler, k=rng.randint(0, 60))
            for own in filter(None, (t, other)):
                notice = words_of(own.text.encode())
                if len(notice) > 30:  # two words left out, one put in
                    for _ in range(2):
                        notice.pop(rng.randrange(len(notice)))
                    notice.insert(rng.randrange(len(notice)), b"acme")
                words = [*words, *notice, *rng.choices(filler, k=rng.randint(0, 40))]
            got = {}
            for label, _, n, score in matches(index, words):
                got[label, n] = max(got.get((label, n), 0), score)
            want = brute_matches(index, words)
            assert got.keys() == want.keys() and all(want[x] - 0.1 < got[x] <= want[x] + 1e-9 for x in want)  # a match stands where its rare words do
            seen |= {label for label, _ in got}
        assert t.label in {m[0] for m in matches(index, [*filler[:5], *words_of(t.text.encode()), *filler[5:9]])}
    assert len(seen) > len({t.label for t in TEMPLATES}) // 2


def test_defined_cases(odd, nothing):
    got = license_digest(scan_licenses(odd)).collect()
    assert len(got) == odd.count() and all(r["labels"] == "" and r["score"] == 0 for r in got)
    assert license_digest(scan_licenses(nothing)).collect() == []


def test_many_notices_take_linear_time():
    """Each is found, and twice as many take about twice as long."""
    import time

    index, seconds = build_index({}, 0), []
    for n in (2_000, 8_000):
        began = time.time()
        got = matches(index, words_of(b"Released under the MIT License. " * n))
        seconds.append(time.time() - began)
        assert sum(label == "mit" for label, *_ in got) >= n
    assert seconds[1] < 10 * seconds[0] + 0.5
