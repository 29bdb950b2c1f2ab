"""Hashes that decide: texts that break polynomial hashes, and odd chunk sizes."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs_of, prose

from dnslake.llm import minhash, substrings, textops, warc


def thue_morse(n, pair):
    return [pair[bin(i).count("1") % 2] for i in range(n)]


def both(n):
    return "".join(thue_morse(n, "ab")), "".join(thue_morse(n, "ba"))


def hashes(*texts):
    return textops.Words(*textops.flat(pa.array(texts)), textops.lut_alnum_lower()).hash


def test_words_of_one_pattern_differ():
    for n in (64, 1024, 4096, 4097):
        a, b = hashes(*both(n))
        assert a != b
    assert len(set(hashes("abcdefgh12345678", "12345678abcdefgh", "abcdefgh", "abcdefg", "abcdefghx").tolist())) == 5


def test_equal_words_have_equal_hashes_wherever_they_stand():
    words = ["é", "a", "abcdefgh", "abcdefghi", "x" * 100]
    found = hashes(*[" " * k + w + " tail" for k in range(9) for w in words]).reshape(-1, 2)[:, 0].reshape(9, len(words))
    assert (found == found[0]).all() and len(set(found[0].tolist())) == len(words)
    lane = textops.Words(*textops.flat(pa.array(words)), textops.lut_alnum_lower(), 1).hash
    assert not np.intersect1d(lane, found[0]).size


def test_unlike_documents_stay(spark):
    words = both(4096)
    sequences = [" ".join(thue_morse(4096, p)) for p in (("xx", "yy"), ("yy", "xx"))]
    rows = [(1, words[0]), (2, words[1]), (3, sequences[0]), (4, sequences[1])]
    done = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert done[1] == 1 and done[2] == 2 and done[4] == 4


def test_words_that_repeat_nowhere_stay(spark):
    shared = prose(1, 34)
    rows = [(k, f"{shared} {w}") for k, w in enumerate(both(4096))]
    assert [r.n_removed for r in substrings.remove_repeats(docs_of(spark, rows)).collect()] == [0, 0]
    again = [(k, f"{shared} {both(4096)[0]}") for k in range(2)]
    assert [r.n_removed for r in substrings.remove_repeats(docs_of(spark, again)).collect()] == [35, 35]


@pytest.mark.parametrize("size", [b"-6", b"+4", b"0x4", b"4_0", b"", b"zz"])
def test_odd_chunk_sizes_end(size):
    body = size + b"\r\nabcd\r\n0\r\n\r\n"
    assert warc._unchunked(body) == body


def test_chunks():
    assert warc._unchunked(b"4\r\nabcd\r\n2;x=y\r\nef\r\n0\r\n\r\n") == b"abcdef"
    assert warc._unchunked(b"A \r\n0123456789\r\n0\r\n") == b"0123456789"
