"""Golden bytes, round trips and edge cases of the codecs and the stemmer."""

import random

import pytest

from quernstone.functions import bits, chunks, interpolative, sortable, stem, varint, vs

VALUES = [0, 1, 127, 128, 300, 16383, 16384, 4294967295]
MIXED = [(4, 5), (6, 254), (8, 1024), *((d, 2 * d) for d in range(9, 18)), (27, 32), (35, 68), *((d, d - 39) for d in (40, 41)), *((d, 256 + 3 * d) for d in range(47, 52))]
SKIP8 = [(4, 3), (5, 7), (9, 2), (15, 3), (16, 4), (18, 11), (27, 20), (37, 40)]
SKIP2047 = [(d, 2 * d) for d in range(1, 2048)]
LIST = [3, 4, 5, 6, 7, 8, 1000, 1001, 1002, 1003, 5000]


def test_varint_golden():
    assert [varint.put(v).hex() for v in VALUES] == ["00", "01", "7f", "8001", "ac02", "ff7f", "808001", "ffffffff0f"]
    assert [varint.get(varint.put(v)) for v in VALUES] == [(v, varint.size(v)) for v in VALUES]


def test_sortable_golden_and_order():
    assert [sortable.put_uint(v).hex() for v in VALUES] == ["0000", "0001", "007f", "0080", "012c", "3fff", "404000", "c0ffffffff"]
    some = sorted(random.Random(1).sample(range(1 << 32), 500)) + []
    keys = [sortable.put_uint(v) for v in some]
    assert keys == sorted(keys) and [sortable.get_uint(k)[0] for k in keys] == some


def test_keys():
    assert sortable.posting_key(b"").hex() == "00e0"
    assert sortable.posting_key(b"", 1).hex() == "00e00001"
    assert sortable.posting_key(b"the").hex() == "746865"
    assert sortable.posting_key(b"the", 300).hex() == "74686500012c"
    assert sortable.posting_key(b"a\0b", 1).hex() == "6100ff62000001"
    for term, did in [(b"", None), (b"", 7), (b"the", None), (b"a\0b", 70000), (b"\0", 2)]:
        assert sortable.split_key(sortable.posting_key(term, did)) == (term, did)
    assert sortable.key_is_of(b"the", b"the") and not sortable.key_is_of(b"then", b"the")


def test_errors():
    with pytest.raises(varint.CorruptData):
        varint.get(b"\x80")
    with pytest.raises(varint.ValueRange):
        varint.get(b"\xff\xff\xff\xff\x7f")
    with pytest.raises(varint.ValueRange):
        varint.get(b"\x80\x80\x80\x80\x80\x00")
    with pytest.raises(varint.CorruptData):
        chunks.decode_lengths(b"\x00", 1)
    with pytest.raises(ValueError):
        vs.encode([2, 2])


def test_small_encodings():
    for v in VALUES:
        assert varint.get_last(varint.put_last(v)) == v
        assert varint.get_fixed(varint.put_fixed(v, 4), 0, 4) == (v, 4)
    assert varint.put_last(0) == b""
    assert [varint.byte_width(v) for v in (0, 255, 256, 65535, 65536)] == [1, 1, 2, 2, 3]
    assert varint.get_bool(varint.put_bool(True)) == (True, 1)
    assert varint.get_string(varint.put_string(b"abc")) == (b"abc", 4)


def test_bits():
    assert [str(bits.Bits().gamma(v)) for v in (1, 2, 7, 9, 24, 6)] == ["0", "100", "11011", "1110001", "111101000", "11010"]
    for v in (1, 2, 5, 7, 8, 9, 24, 6, 123, 16):
        assert bits.BitReader(str(bits.Bits().unary(v))).unary() == v == bits.unary_length(v)
        assert bits.BitReader(str(bits.Bits().gamma(v))).gamma() == v
        assert bits.gamma_length(v) == bits.Bits().gamma(v).count


def test_vs():
    assert vs.encode([2, 5, 7, 9, 24]).hex() == "2f060518cf88c8"
    assert vs.encode([2, 5, 7, 9, 24, 6], wrap=True).hex() == "02020606cf88c8bfe0bffffffb"
    assert vs.encode(LIST).hex() == "1d060b8827bb59bf3df000200f58007e"
    assert vs.greedy_cuts(vs.gaps(LIST)) == [0, 3, 6, 9, 11]
    assert vs.decode(vs.encode([2, 5, 7, 9, 24, 6], wrap=True)) == [2, 5, 7, 9, 24, 6]
    assert [vs.log2_up(v) for v in (1, 2, 3, 4, 128, 255, 256, 257, 512, 1024, 65536)] == [0, 1, 2, 2, 7, 8, 9, 9, 10, 11, 17]
    assert vs.header(vs.encode(LIST)) == (11, 5000)
    for v in (1, 2, 255, 65534):
        assert vs.decode(vs.encode([v])) == [v]


def test_interpolative():
    assert interpolative.encode([2, 5, 7, 9, 24]).hex() == "18628c01"
    assert interpolative.encode(LIST).hex() == "88270320010080eff91e000000"
    with pytest.raises(varint.CorruptData):
        interpolative.decode(interpolative.encode(LIST) + b"\0")


def test_chunk_bodies():
    first = MIXED[0][0]
    body = chunks.encode_lengths(MIXED)
    assert body.hex() == "000502fe01028008ffffffff0f01090001121416181a1c1e20220a20084405010102068d03019003019303019603019903"
    assert chunks.decode_lengths(body, first) == MIXED
    assert [(MIXED[a][0], b - a) for a, b in chunks.segments(MIXED) if b - a >= 6] == [(9, 9)]
    posting = chunks.encode_postings(MIXED)
    assert posting.hex() == "0501fe010180080012001400160018001a001c001e002000220920074404010002058d03009003009303009603009903"
    assert chunks.decode_postings(posting, first) == MIXED
    assert (chunks.first_header(0, 0, 4) + chunks.chunk_header(4, 51, True)).hex() == "000003312f"
    assert chunks.read_first_header(chunks.first_header(3, 9, 4)) == (3, 9, 4, 3)
    big = chunks.encode_lengths(SKIP2047)
    assert [(SKIP2047[a][0], b - a) for a, b in chunks.segments(SKIP2047)] == [(1, 127), (128, 1920)] and len(big) == 3985


def test_point_reads():
    body = chunks.encode_lengths(MIXED)
    want = dict(MIXED)
    for did in range(0, 60):
        assert chunks.find_length(body, 4, did) == want.get(did)
    for pairs in (SKIP8, SKIP2047):
        enc = chunks.encode_skips(pairs)
        want = dict(pairs)
        assert chunks.decode_skips(enc, pairs[0][0]) == pairs
        for did in range(0, pairs[-1][0] + 12):
            assert chunks.skip_find(enc, pairs[0][0], did) == want.get(did)


def test_skip_golden():
    assert chunks.encode_skips(SKIP8).hex() == "ffffffff0f060b0003010704020603ffffffff0f06160104020b09140a28"
    assert len(chunks.encode_skips(SKIP2047)) == 6602 and len(chunks.encode_skips(SKIP2047, 0)) == 6078
    assert [chunks.skip_levels(n) for n in (1, 3, 4, 15, 16, 63, 64, 251, 252, 1000, 2047)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 5]


def test_edges_round_trip():
    rng = random.Random(5)
    lists = [[], [1], [varint.SENTINEL - 1], list(range(1, 6)), list(range(1, 7)), list(range(5, 4005))]
    lists += [sorted(rng.sample(range(1, 200_000), n)) for n in (2, 3, 10, 200, 2001)]
    for dids in lists:
        pairs = [(d, rng.choice([0, 1, 255, 256, 65535, 65536])) for d in dids]
        first = dids[0] if dids else 0
        assert vs.decode(vs.encode(dids)) == dids
        assert vs.decode(vs.encode(dids, optimal=True)) == dids
        assert interpolative.decode(interpolative.encode(dids)) == dids
        assert chunks.decode_lengths(chunks.encode_lengths(pairs), first) == pairs
        assert chunks.decode_postings(chunks.encode_postings(pairs), first) == pairs
        assert chunks.decode_skips(chunks.encode_skips(pairs), first) == pairs
        gap = vs.gaps(dids)
        if gap:
            cost = [sum(vs.part_bits(gap[a:b]) for a, b in zip(c, c[1:])) for c in (vs.optimal_cuts(gap), vs.greedy_cuts(gap))]
            assert cost[0] <= cost[1] or max(b - a for a, b in zip(vs.greedy_cuts(gap), vs.greedy_cuts(gap)[1:])) > vs.MAX_PART


def test_stems():
    want = "maximum maxim 48;presumably presum 36;multiply multiply 99;provision provid 25;owed ow 11;ear ear 0;saying say 16;meant meant 82;cement cement 80;happy happy 0;running run 58;connections connect 53;is is 76;the the 0;eat eat 0;bus b 75;glass glass 73;ponies pony 69;universities univer 77;conditional condit 53;adjustment adjust 80;indices ind 5;analytics analys 4;sensitive sensit 96;hopefulness hop 13"
    for entry in want.split(";"):
        word, stemmed, rule = entry.split()
        assert (word, *stem.stem_with_rule(word)) == (word, stemmed, int(rule))
    assert len(stem.ALL) == 115
    assert stem.stem("") == "" and stem.stem("don'") == "don'" and stem.stem("RUNNING") == "RUNNING"


def test_many_values_at_once():
    import numpy as np

    from quernstone.functions import varint

    some = [0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 32) - 1]
    buf, size = varint.puts(np.array(some))
    assert buf.tobytes() == b"".join(map(varint.put, some)) and size.tolist() == [varint.size(v) for v in some]
    back, ends = varint.gets(buf)
    assert back.tolist() == some and ends.tolist() == np.cumsum(size).tolist()
    for bad, error in ((b"\x80", varint.CorruptData), (b"\xff" * 5 + b"\x01", varint.ValueRange), (b"\xff\xff\xff\xff\x1f", varint.ValueRange)):
        with pytest.raises(error):
            varint.gets(np.frombuffer(bad, np.uint8))


def test_stored_chunks_split_once(spark):
    """Headers, bodies and totals of stored chunks come from one split of the lists."""
    from quernstone import catalog

    rows = catalog.QUERIES["stored_headers"](spark, "/root/testdata/sf0.001")
    rows._jdf.collectAsList()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow through") <= 2
