import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from formbook.llm import queries, sql

from .test_quality import brute as brute_counts
from .test_repeats import brute as brute_repeats
from .test_secrets_and_licenses import brute_base
from .test_simhash import brute_print, grouped

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = list(queries.registered())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(entry.queries())
    assert set(sql.statements()) <= set(names)


@pytest.mark.parametrize("name", sorted(sql.statements()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    _, rows, verdict = compare(spark, con, FOLDER, name, queries.registered()[name], sql.statements()[name])
    assert verdict.startswith("exact") and rows > 0, verdict


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def found(spark, name, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in queries.registered()[name](spark, FOLDER).collect()}


def test_op4_values(spark, texts):
    want = {r[0]: r[1:] for r in brute_repeats([(i, texts[i].encode()) for i in sorted(texts)], 100)}
    assert found(spark, "op4_repeats", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op5_values(spark, texts):
    ids = sorted(texts)
    prints = [brute_print(texts[i]) for i in ids]
    roots = grouped(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    want = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots)}
    assert found(spark, "op5_simhash", "fingerprint", "component_id") == want


def test_op6_pieces_are_those_of_the_named_library(spark, texts):
    """Ids of whole documents by the tokenizers library itself, cut and packed."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, room = {}, {}
    for doc_id, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        at, first = 0, (len(ids) - 1) % 2048 + 1
        for piece, stop in enumerate(range(first, len(ids) + 1, 2048)):
            want[doc_id, piece] = (at, stop - at, zlib.crc32(np.array(ids[at:stop], dtype="<u4").tobytes()))
            at = stop
    rows = queries.registered()["op6_packing"](spark, FOLDER).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0) and r.offset + r.length <= 2048
        room[r.sequence_id] = r.offset + r.length
    assert len(room) <= -(-sum(w[1] for w in want.values()) // 2048) + 1


def test_op7_values(spark, texts):
    want = {}
    for doc_id, text in texts.items():
        base = brute_base(text)
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        want[doc_id] = (*[sum(k == n for _, k, _ in base) for n in range(3)], hashlib.sha256(written.encode()).hexdigest())
    assert found(spark, "op7_secrets", "n_assign", "n_access", "n_hex", "base_sha256") == want


def test_op9_is_a_prediction_for_every_document(spark, texts):
    got = found(spark, "op9_language_id", "held_out", "lang_pred", "score")
    assert {i: g[0] for i, g in got.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    assert all(0 <= g[2] <= 1 and (g[1] == "und") == (not any(map(str.isalpha, texts[i]))) for i, g in got.items())


def test_op10_values(spark, texts):
    got = found(spark, "op10_quality_rules", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for doc_id, text in texts.items():
        counts = brute_counts(text)
        assert got[doc_id] == (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def test_op11_values(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = found(spark, "op11_bpe", "n_tokens", "ids_sha256", "decoded_sha256")
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
