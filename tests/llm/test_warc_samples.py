"""The dictionary is trained on whole records."""

from __future__ import annotations

import io
import random

from pixlens.llm import warc


def test_records_are_sampled_whole(monkeypatch):
    rnd = random.Random(2)
    records = [rnd.randbytes(300_000), b"short", rnd.randbytes(200_000)]
    seen = []
    monkeypatch.setattr(warc, "train_dictionary", lambda samples: seen.append(samples) or b"")
    assert warc.write_archive(io.BytesIO(), iter(records)) == (3, 0)
    assert b"".join(seen[0]) == b"".join(records) and max(map(len, seen[0])) <= warc.PIECE_BYTES
    warc.write_archive(io.BytesIO(), iter(records), sample_bytes=400_000)
    assert b"".join(seen[1]) == b"".join(records)[:400_000]


def test_archives_of_any_size_have_a_dictionary():
    rnd = random.Random(3)
    text = b"<html><body>" + b" ".join(rnd.choice([b"one", b"two", b"three"]) for _ in range(40)) + b"</body></html>"
    for records in ([b"x"], [text] * 3, [text + bytes([i]) for i in range(15)], [b""] * 5, [rnd.randbytes(50)] * 40,
                    [text + rnd.randbytes(9) for _ in range(200)]):
        out = io.BytesIO()
        n, held = warc.write_archive(out, iter(records))
        assert n == len(records) and (held > 0 or not any(records))
        out.seek(0)
        if held:
            assert int.from_bytes(out.getvalue()[:4], "little") == warc.DICT_MAGIC
            assert int.from_bytes(out.getvalue()[4:8], "little") == held
        assert list(warc.read_archive(out)) == records
