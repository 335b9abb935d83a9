"""Token files: mixing, blocks on their own, damage, and ids that don't fit."""

import numpy as np
import pytest

from inkveil.llm import rangecoder


def test_blocks_are_coded_alike_alone_and_together():
    r = np.random.default_rng(4)
    blocks = [np.minimum(r.zipf(1.2, n), 60000) for n in (4096, 17, 1, 0, 900)]
    together = rangecoder.encode_blocks(blocks)
    for block, payload in zip(blocks, together, strict=True):
        assert rangecoder.decode_blocks([payload], [len(block)])[0].tolist() == block.tolist()


def test_every_rank_has_a_share_and_shares_do_not_overlap():
    """Whatever the model has learned, the mixed shares of a lane's ranks follow one another from 0."""
    r = np.random.default_rng(6)
    said = r.integers(0, 7, 300).astype(np.int32)
    model = rangecoder.Model(np.array([7]))
    for x in said:
        model.predict()
        begins, sizes = zip(*((int(b[0]), int(s[0])) for b, s in (model.span(np.array([k], np.int32)) for k in range(7))), strict=True)
        assert begins[0] == 0 and min(sizes) > 0 and all(b + s == n for b, s, n in zip(begins, sizes, begins[1:], strict=False)) and begins[-1] + sizes[-1] <= rangecoder.ALL
        row = np.array([x], np.int32)
        _, size = model.span(row)
        model.learn(row, size)


def test_predictable_ids_are_short():
    r = np.random.default_rng(5)
    phrase = r.integers(0, 40000, 200)
    random = r.integers(0, 40000, 4000)
    often, never = rangecoder.encode_blocks([np.tile(phrase, 20), random])
    assert len(often) < 1400 and 6000 < len(never) < 10500


def test_large_ids_are_refused():
    with pytest.raises(ValueError, match="65536"):
        rangecoder.encode_blocks([np.array([1, 65536])])


def test_damage_is_found(spark, docs, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = tmp_path / "ids"
    rangecoder.write_ids(docs, str(path))
    file = max(path.glob("*.parquet"), key=lambda p: p.stat().st_size)
    table = pq.read_table(file)
    rows = table.to_pylist()
    payload = bytearray(rows[0]["blocks"][0]["payload"])
    payload[len(payload) // 2 + 50] ^= 4
    rows[0]["blocks"][0]["payload"] = bytes(payload)
    pq.write_table(pa.Table.from_pylist(rows, table.schema), file)
    (path / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="another checksum|damaged"):
        rangecoder.read_ids(spark, str(path)).collect()


def test_empty_table(spark, empty, tmp_path):
    rangecoder.write_ids(empty, str(tmp_path / "ids"))
    assert rangecoder.read_ids(spark, str(tmp_path / "ids")).count() == 0
