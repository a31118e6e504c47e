"""Samples in parts: comparators, exchange files and digests."""

import numpy as np

from countloom.operators import coder
from countloom.sources import archive
from tests.test_model import DENSE, build


def test_parts_of_a_sample(spark):
    m = build(spark, DENSE["mixed"])
    for encode, decode in (
        (archive.comparator_archives, archive.decode_comparators), (lambda x, part: archive.comparator_archives(x, "CSC_BZIP2_9", part), archive.decode_comparators),
        (archive.external_archives, archive.decode_external), (archive.exchange_files, archive.decode_exchange),
    ):
        files = encode(m, part=50).cache()
        assert files.count() > 3
        assert archive.cells_match(decode(files), m).first()["identical"]
    rows = coder.comparators(m, 50).collect()
    assert len(rows) == 6 and all(r["exact"] for r in rows)


def test_digest_of_parts(spark):
    for dense in (DENSE["mixed"], DENSE["smoke"]):
        i, g = np.nonzero(dense)
        want = coder.digest_of(*dense.shape, np.concatenate([[0], np.cumsum((dense > 0).sum(1))]), g, dense[i, g])
        assert {r["digest"] for part in (3, 50) for r in coder.digest(build(spark, dense), part).collect()} == {want}
