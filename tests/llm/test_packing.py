import random
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from twinbuild.llm.packing import WordIds, best_fit, joined_ids, pack, parts, plan_bins, reduce_dominated, token_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")


def optimum(sizes, capacity):
    best = len(sizes)
    for order in set(permutations(sizes)):
        bins, room = 1, capacity
        for s in order:
            if s > room:
                bins, room = bins + 1, capacity
            room -= s
        best = min(best, bins)
    return best


def histogram(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1)


def test_plan_holds_every_piece_once():
    rng = random.Random(3)
    for capacity in (10, 64, 4096):
        for _ in range(60):
            counts = histogram([rng.randint(1, capacity) for _ in range(rng.randint(1, 300))], capacity)
            table, bins = plan_bins(counts, capacity)
            filled = np.zeros(bins, int)
            for size in np.flatnonzero(counts):
                rows = table[table[:, 0] == size]
                for rank in range(counts[size]):
                    row = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1]
                    nth = rank - row[1]
                    assert row[4] + nth % row[2] * size + size <= capacity
                    filled[row[3] + nth // row[2]] += size
            assert (filled > 0).all() and (filled <= capacity).all() and filled.sum() == (counts * np.arange(capacity + 1)).sum()


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(150):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 7))]
        counts = histogram(sizes, 12)
        fixed = reduce_dominated(counts, 12)
        rest = [s for s in range(13) for _ in range(counts[s])]
        assert sum(n for n, _ in fixed) + (optimum(rest, 12) if rest else 0) == optimum(sizes, 12)


def test_best_fit_is_that_of_single_pieces():
    rng = random.Random(5)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 40))), reverse=True)
        rooms = []
        for s in sizes:
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms[rooms.index(min(fits))] -= s
            else:
                rooms.append(20 - s)
        assert sum(n for n, _ in best_fit(histogram(sizes, 20), 20)) == len(rooms)


def test_pieces_are_the_tokenizers(spark, sf_dir, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(FILE)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id % 5 = 0").unionByName(odd.where("doc_id <> 5").selectExpr("doc_id + 100000 doc_id", "text"))
    got = pack(token_pieces(docs, FILE)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {}
    for doc, text in texts.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[doc, piece] = (start, len(part), crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= 1.02 * sum(r["length"] for r in got) / 4096 + 1


def test_defined_cases(odd, nothing):
    got = pack(token_pieces(odd, FILE)).collect()
    assert len([r for r in got if r["doc_id"] == 5]) == 2 and [r["length"] for r in got if r["doc_id"] == 0] == [1]
    assert pack(token_pieces(nothing, FILE)).collect() == []


def test_forgetting_between_parts_changes_no_ids():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["".join(rng.choices("abcdeé", k=rng.randint(1, 4))), "don't", "x1.", "漢字!", "..."]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    batch = pa.record_batch({"text": [*texts, "", "word " * 400]})
    whole, bounds = joined_ids(batch.column(0), WordIds(FILE), 1)
    small, got, ends = WordIds(FILE, remember=7), [], []
    cut = list(parts(batch, most=300))
    for part in cut:
        ids, at = joined_ids(part.column(0), small, 1)
        got += ids.tolist()
        ends += np.diff(at).tolist()
        small.forget(above=9)
        assert len(small.words) <= 9
    assert len(cut) > 5 and sum(p.num_rows for p in cut) == batch.num_rows
    assert got == whole.tolist() and ends == np.diff(bounds).tolist()
    assert list(parts(batch.slice(0, 0))) == []
