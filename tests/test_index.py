"""The index of search entries against plain scans."""

import random
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest

from lexweave.operators import index as ix, retrieval as R
from lexweave.session import fresh_folder

ENTRY = "kind string, canonical_ref string, title string, body string, ref_article string, ref_law string, ecli string, case_number string"


def test_pieces():
    rng = random.Random(2)
    strings = ["", "a", "é", "𝒳y", *["".join(rng.choices("abcß ", k=rng.randrange(1, 9))) for _ in range(300)]]
    pieces = ix.Pieces(strings, *ix.Pieces.built(strings))
    for part in ["", "a", "ab", "abc", "é", "𝒳", "𝒳y", "zz", "zzz", "abca", *rng.sample(strings, 50)]:
        assert pieces.holding(part).tolist() == [i for i, s in enumerate(strings) if part in s]
    assert ix.Pieces([], *ix.Pieces.built([])).holding("abc").tolist() == []


@pytest.fixture(scope="module")
def corpus(spark):
    """Entries with few words that repeat, words inside words, null texts, and one long text."""
    rng = random.Random(12)
    vocab = ["a", "an", "nation", "nationality", "ration", "naïve", "NAIVE", "Άρθρο", "αρθρο", "x1", "court", "the", "them", "theme", "·"]
    rows = [("d", f"r{i}", rng.choice(vocab), " ".join(rng.choices(vocab, k=rng.randrange(0, 30))), str(i % 9), None, None, f"{i}/2019") for i in range(400)]
    rows += [("d", "none", None, None, None, None, None, None), ("e", "long", "the", "court " * 5000 + "theme", None, None, None, None)]
    queries = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 6)))) for i in range(40)]
    queries += [(100, "3"), (101, "..."), (102, "the, them"), (103, "court court court theme"), (104, "17/2019"), (105, ""), (106, None)]
    return spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(rows, ENTRY).repartition(3)


@pytest.mark.parametrize("most", [7, 4096])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_best_of_index_is_best_of_all(spark, corpus, most, k):
    """What the bounds leave out is never among the best; segments of any size give the same rows."""
    queries, entries = corpus
    index = ix.write_index(entries, fresh_folder(spark, "index"), most)
    got = sorted(tuple(r) for r in R.lexical_search(queries, entries, k, index).collect())
    every: dict[int, list] = {}
    for r in R.lexical_scores(queries, entries).collect():
        every.setdefault(r.query_id, []).append((-r.score, r.canonical_ref, r.kind, r.phrase))
    want = [(q, kind, ref, -s, phrase, i) for q, rows in every.items() for i, (s, ref, kind, phrase) in enumerate(sorted(rows)[:k], 1)]
    assert got == sorted(want) and len({q for q, *_ in want}) > 30


def test_empty_index(spark, corpus):
    queries, entries = corpus
    assert R.lexical_search(queries, entries.limit(0), 5).collect() == []
    assert R.lexical_search(queries.limit(0), entries, 5).collect() == []


def test_writer_holds_one_segment(spark, corpus):
    """A row group, which writer and reader hold whole, is one segment."""
    folder = fresh_folder(spark, "index")
    n = ix.write_index(corpus[1], folder, 7).count()
    files = [pq.read_metadata(f) for f in Path(urlparse(folder).path).glob("*.parquet")]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert n > 50 and groups == [1] * n
