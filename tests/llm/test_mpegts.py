import hashlib
import zlib

from intakespark.llm import mpegts, queries


def test_round_trip_lengths():
    for n in [*range(0, 700, 7), 4095, 4209, 4210, 4211, 4224, 8420, 8421, 40_000, 123_457]:
        payload = mpegts.pad(bytes(i * 31 % 256 for i in range(n)))
        assert len(payload) % 64 == 0 and len(payload) >= 64
        media = mpegts.mux(payload)
        assert len(media) % 188 == 0 and all(media[k] == 0x47 for k in range(0, len(media), 188))
        s = mpegts.Stream(media)
        assert bytes(s.bytes[mpegts.ES_PID]) == payload
        assert (s.bad, s.bad_tables, s.discontinuities, s.duplicates) == (0, 0, 0, 0)
        assert [u[1] for u in s.units] == [k * 3600 for k in range(len(s.units))]
        assert [u[2] for u in s.units] == [k % 8 == 0 for k in range(len(s.units))]
    assert s.programs == {mpegts.PMT_PID: 1} and s.kinds == {mpegts.ES_PID: 6}


def test_any_payload_length_packs():
    for n in range(1, 600):
        s = mpegts.Stream(mpegts.mux(b"\x47" * n))
        assert bytes(s.bytes[mpegts.ES_PID]) == b"\x47" * n and not s.bad


def test_damage_is_counted():
    media = mpegts.mux(bytes(20_000))
    lost = mpegts.Stream(media[: 188 * 5] + media[188 * 6 :])
    assert lost.discontinuities == 1
    twice = mpegts.Stream(media[: 188 * 6] + media[188 * 5 :])
    assert (twice.duplicates, twice.discontinuities) == (1, 0) and len(twice.bytes[mpegts.ES_PID]) == 20_000
    torn = bytearray(media)
    torn[10] ^= 1
    assert mpegts.Stream(bytes(torn)).bad_tables == 1
    assert mpegts.Stream(b"").features().startswith("packets=0;")


def test_timestamps_wrap_33_bits():
    for t in (0, 1, 90_000, (1 << 33) - 1, 0x155555555, 0x0AAAAAAAA):
        assert mpegts._read_timestamp(mpegts._timestamp(2, t)) == t


def test_nulls_copies_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "é" * 70, "c"), (3, "é" * 70, "c"), (None, "x", None)], "doc_id long, text string, media string")
    rows = mpegts.read_media(mpegts.store_media(df)).collect()
    assert len(rows) == 5
    for r in rows:
        assert r.payload == mpegts.pad((r.text or "").encode())
    assert len({(r.media, r.feature) for r in rows if r.doc_id == 3}) == 1
    assert mpegts.read_media(mpegts.store_media(df.limit(0))).count() == 0


def test_query_whole_table(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op6_mpegts_media(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        media = mpegts.mux(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
