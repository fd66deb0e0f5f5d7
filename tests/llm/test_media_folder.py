"""What the stored streams take on disk."""

import random
from pathlib import Path

from fwlens.llm import flac


def test_streams_take_less_room_on_disk_than_their_bytes(spark, tmp_path):
    """Short unlike texts, so that headers and seek tables weigh; the streams themselves come back bit for bit."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randint(200, 1500))) for _ in range(1500)]
    path = tmp_path / "media"
    flac.store_texts(spark.createDataFrame([*enumerate(texts), (9000, texts[0]), (9001, texts[0])], "doc_id long, text string").coalesce(1), str(path))
    own = [r["media"] for r in flac.stored_media(spark, str(path)).where("doc_id BETWEEN 1 AND 1499").orderBy("doc_id").collect()]
    assert own == flac.encode_payloads([flac.payload_of(t) for t in texts[1:]])
    on_disk = {name: sum(f.stat().st_size for f in (path / name).rglob("*.parquet")) for name in ("own", "common")}
    assert on_disk["own"] < 0.97 * sum(map(len, own))
    assert all(r["ok"] for r in flac.digests_of_stored(spark, str(path)).collect())
