import os
import random

import numpy as np
import pytest

from webloom.llm import chroma as module
from webloom.llm.chroma import DOUBT, SHORT, Audio, align, chroma, fingerprint, fingerprints, neighbours

DATA = "/root/testdata/sf0.001"


def sounds(seed=1, n=120):
    r = random.Random(seed)
    out = []
    base = [bytes(r.choices(b"etaoin shrdlu.,\n", k=r.randint(900, 4000))) for _ in range(6)]
    for i in range(n):
        kind = r.random()
        if kind < 0.3:
            s = r.choice(base)
        elif kind < 0.6:
            s = bytearray(r.choice(base))
            for _ in range(3):
                s[r.randrange(len(s))] = 65
            s = bytes(s)
        elif kind < 0.8:
            b = r.choice(base)
            s = b[64 * r.randint(0, 5) :] + bytes(r.choices(b"xyz q", k=300))
        else:
            s = bytes(r.choices(b"abcdefgh ijkl mnop", k=r.randint(0, 3000)))
        out.append((i, s))
    return out + [(1000, None), (1050, b""), (None, base[0]), (2000, b"\x80" * 3000), (2001, b"a" * 5000)]


def brute(prints, every, least, rate):
    first = {}
    for d, p in sorted((x for x in prints if x[0] is not None and len(x[1])), key=lambda x: x[0]):
        first.setdefault(p.tobytes(), d)
    asked = {first[p.tobytes()] for d, p in prints if d is not None and len(p) and d % every == 0}
    by = {c: np.frombuffer(k, np.uint32) for k, c in first.items()}
    found = set()
    for q in asked:
        for c, b in by.items():
            a = by[q]
            if c == q:
                continue
            for off in range(-len(a) + least, len(b) - least + 1):
                x, y = a[max(0, -off) :], b[max(0, off) :]
                n = min(len(x), len(y))
                if n >= least and int(np.bitwise_count(x[:n] ^ y[:n]).sum()) <= rate * 32 * n:
                    found.add((q, c))
                    break
    return found


def test_search_against_brute_force(spark):
    rows = sounds()
    df = spark.createDataFrame([(d, s, "x") for d, s in rows], "doc_id long, sound binary, class string")
    prints = fingerprints(df, sound_column="sound")
    raw = [(r.doc, np.array(r.print, np.int32).view(np.uint32)) for r in prints.collect()]
    out = align(prints, every=5).collect()
    got = {(r.class_id, r.match_class) for r in out if r.match_class is not None}
    want = brute(raw, 5, 8, 0.2)
    assert len(got & want) >= 0.9 * len(want) > 0
    assert got <= want
    members = [r for r in out if r.match_class is None]
    assert len(members) == len(rows)
    assert all(r.bit_errors <= 0.2 * 32 * r.overlap for r in out if r.match_class is not None)


def test_kernel_basics():
    t = np.arange(8000) / 8000
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    assert (chroma(tone, Audio(frame=2048, hop=512)).argmax(1) == 0).all()
    noise = np.random.default_rng(1).random(4000).astype(np.float32)
    whole = fingerprint(chroma(noise, Audio()))[0]
    assert (fingerprint(chroma(noise[640:], Audio()))[0] == whole[10:]).all()
    assert len(fingerprint(chroma(noise[:100], Audio()))[0]) == 0


def test_empty_table(spark):
    assert align(fingerprints(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def edited(sound, places):
    out = bytearray(sound)
    for i in places:
        out[i : i + 6] = bytes(x ^ 31 for x in out[i : i + 6])
    return bytes(out)


def found_and_wanted(spark, rows, every):
    prints = fingerprints(spark.createDataFrame(rows, "doc_id long, sound binary"), sound_column="sound")
    raw = [(r.doc, np.array(r.print, np.int32).view(np.uint32)) for r in prints.collect()]
    found = {(r.class_id, r.match_class) for r in align(prints, every=every).collect() if r.match_class is not None}
    return found, brute(raw, every, 8, 0.2)


def test_edits_in_every_stretch_and_short_overlaps(spark):
    r = np.random.default_rng(3)
    size = 704 + 64 * 176  # 177 integers
    rows = []
    for i in range(4):
        whole = r.integers(0, 256, size, np.uint8).tobytes()
        rest = r.integers(0, 256, size, np.uint8).tobytes()
        rows += [(10 * i, whole), (10 * i + 1, edited(whole, range(size // 16, size, size // 8))), (10 * i + 2, whole[64 * 130 : 64 * 130 + 704 + 64 * 9] + rest)]
        rows.append((10 * i + 3, whole[64 * (150 + i) :]))
    found, want = found_and_wanted(spark, rows, 10)
    assert {(10 * i, 10 * i + k) for i in range(4) for k in (1, 3)} <= want
    assert found == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_real_documents_with_edits(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("octet_length(text) between 2000 and 9000").orderBy("doc_id").limit(20).collect()
    sounds = [r.text.encode() for r in docs]
    rows = [(10 * i, s) for i, s in enumerate(sounds)] + [(10 * i + 1, edited(s, range(len(s) // 16, len(s), max(900, len(s) // 8)))) for i, s in enumerate(sounds)]
    found, want = found_and_wanted(spark, rows, 10)
    planted = {(10 * i, 10 * i + 1) for i in range(len(sounds))} & want
    assert len(planted) >= 5
    assert planted <= found <= want


def test_neighbours_and_doubt():
    r = np.random.default_rng(4)
    sound = r.random(6000).astype(np.float32)
    value, doubt = fingerprint(chroma(sound, Audio()))
    assert (np.bitwise_count(doubt) == DOUBT).all()
    near = neighbours(value, doubt)
    assert near.shape == (len(value), 2**DOUBT)
    for v, d, row in list(zip(value, doubt, near, strict=True))[:5]:
        assert set(row.tolist()) == {int(v) ^ sum(1 << b for i, b in enumerate(b for b in range(32) if int(d) >> b & 1) if k >> i & 1) for k in range(2**DOUBT)}
    # Slight noise turns bits; most of them are in doubt.
    noisy = fingerprint(chroma(sound + r.normal(0, 0.004, len(sound)).astype(np.float32), Audio()))[0]
    turned = value ^ noisy
    assert np.bitwise_count(turned).sum() > 0 and np.bitwise_count(turned & doubt).sum() >= 0.8 * np.bitwise_count(turned).sum()


def test_repeated_rows_long_sound_and_clashing_names(spark):
    r = np.random.default_rng(7)
    whole = r.integers(0, 256, 600_000, np.uint8).tobytes()
    rows = [(50, whole, 1, 2), (50, whole, 1, 2), (7, whole[64 * 3000 :], 1, 2), (8, b"", 1, 2)]
    out = align(fingerprints(spark.createDataFrame(rows, "doc_id long, sound binary, class int, print int"), sound_column="sound")).collect()
    assert sorted((x.doc_id, x.class_id) for x in out if x.match_class is None) == [(7, 7), (8, 8), (50, 50), (50, 50)]
    assert [(x.doc_id, x.match_class, x.offset, x.bit_errors) for x in out if x.match_class is not None] == [(50, 7, -3000, 0)]


def alignments(prints, query, other, offset):
    """Overlap, bit errors and neighbours met when integer i of ``query`` stands beside i + offset of ``other``."""
    (a, doubt), (b, _) = prints[query], prints[other]
    x, y = a[max(0, -offset) :], b[max(0, offset) :]
    n = min(len(x), len(y))
    wrong = x[:n] ^ y[:n]
    return n, int(np.bitwise_count(wrong).sum()), int(((wrong & ~doubt[max(0, -offset) :][:n]) == 0).sum())


def test_bit_errors_count_32_bits_and_the_best_offset_wins(spark):
    df = spark.createDataFrame([(d, s) for d, s in sounds(5) if d is not None], "doc_id long, sound binary")
    prints = fingerprints(df, sound_column="sound")
    by = {r.doc: tuple(np.array(x, np.int32).view(np.uint32) for x in (r.print, r.doubt)) for r in prints.collect()}
    out = align(prints, every=5).collect()
    classes = {r.class_id for r in out if len(by[r.class_id][0]) >= 8}
    want = {}
    for q in {r.class_id for r in out if r.match_class is None and r.doc_id % 5 == 0} & classes:
        for c in classes - {q}:
            for offset in range(-len(by[q][0]) + 8, len(by[c][0]) - 7):
                n, wrong, votes = alignments(by, q, c, offset)
                if n >= 8 and (votes or n <= SHORT) and wrong <= 0.2 * 32 * n:
                    want[q, c] = max(want.get((q, c), (0,)), (votes, -abs(offset), offset, n, wrong))
    assert {(r.class_id, r.match_class): (r.offset, r.overlap, r.bit_errors) for r in out if r.match_class is not None} == {k: v[2:] for k, v in want.items()}
    # The highest bit is wrong somewhere: as a sign it would count 33 times.
    tops = [by[q][0][max(0, -o) :][:n] ^ by[c][0][max(0, o) :][:n] for (q, c), (_, _, o, n, _) in want.items()]
    assert any((x >> 31).any() for x in tops)


def test_search_writes_rows_of_recordings_and_matches_only(spark, monkeypatch):
    r = np.random.default_rng(9)
    whole = r.integers(0, 256, 704 + 64 * 60, np.uint8).tobytes()
    rows = [(i, edited(whole, [50 * i])) for i in range(60)]
    counts = []

    def counted(df, name, written=module.written):
        out = written(df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(module, "written", counted)
    prints = fingerprints(spark.createDataFrame(rows, "doc_id long, sound binary"), sound_column="sound")
    matches = align(prints, every=2).where("match_class is not null").count()
    assert matches > 1500
    assert max(counts) <= max(len(rows), matches)


@pytest.mark.parametrize("meetings", [1, 40, 1 << 20])
def test_search_in_pieces(monkeypatch, meetings):
    r = np.random.default_rng(11)
    prints = [r.integers(0, 4, n).astype(np.uint32) << np.uint32(30) for n in (8, 9, 40, 3, 25)] + [np.zeros(30, np.uint32), np.zeros(50, np.uint32)]
    doubt = [np.full(len(p), 0b1111111, np.uint32) for p in prints]
    by = dict(enumerate(zip(prints, doubt, strict=True)))
    want = {}
    for q in by:
        for c in by:
            for offset in range(-len(prints[q]) + 8, len(prints[c]) - 7) if q != c else []:
                n, wrong, votes = alignments(by, q, c, offset)
                if n >= 8 and (votes or n <= SHORT) and wrong <= 1.0 * n:
                    want[q, c] = max(want.get((q, c), (0,)), (votes, -abs(offset), offset, n, wrong))
    monkeypatch.setattr(module, "MEETINGS", meetings)
    monkeypatch.setattr(module, "BLOCK", 16)
    pack = module._Pack(np.arange(len(by)).tobytes(), np.array([len(p) for p in prints]).tobytes(), np.concatenate(prints).tobytes())
    got = {}
    for found in module.search(pack, np.concatenate(doubt), pack, 8, 1.0):
        got |= {(q, c): (v, -abs(o), o, n, w) for q, c, v, o, n, w in zip(*(x.tolist() for x in found), strict=True)}
    assert got == want and len(want) > 10


def test_short_overlaps_are_found_without_a_neighbour(spark):
    r = np.random.default_rng(13)
    whole = r.integers(0, 2**32, 60, np.uint32)

    def noisy(print_):
        """Six bits of every integer are wrong, none in doubt."""
        return print_ ^ np.array([sum(1 << int(b) for b in r.choice(np.arange(8, 32), 6, False)) for _ in print_], np.uint32)

    cases = {0: whole, 1: np.concatenate((noisy(whole[-8:]), r.integers(0, 2**32, 30, np.uint32))), 2: np.concatenate((r.integers(0, 2**32, 30, np.uint32), noisy(whole[:12]))), 3: noisy(whole[20:31]), 4: whole[40:], 50: noisy(whole[5:14])}
    rows = [(d, p.view(np.int32).tolist(), [0b1111111] * len(p)) for d, p in cases.items()]
    out = align(spark.createDataFrame(rows, "doc long, print array<int>, doubt array<int>")).collect()
    got = {(x.doc_id, x.match_class): (x.offset, x.overlap) for x in out if x.match_class is not None}
    assert got == {(0, 1): (-52, 8), (0, 2): (30, 12), (0, 3): (-20, 11), (0, 4): (-40, 20), (0, 50): (-5, 9), (50, 0): (5, 9)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found, want = found_and_wanted(spark, rows, 5)
    assert found <= want
    assert len(found) >= 0.9 * len(want) > 0
