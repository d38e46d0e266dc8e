"""Fill-in-middle, SentencePiece and conversation repair against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("quern.llm")
from pyspark.sql import functions as F
from quern.llm import common, fill_in_middle, sentencepiece_codec, structure_repair


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fim_plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def texts():
    r = random.Random(3)
    letters = "abcXYZ é漢😀\n\t\r0<>PSM"
    out = [None, "", " ", "\n", "word", "a" * 30_000, "漢" * 9_000, "<P>x", "a<S", "<<M>", "<", "P>", "x" * 7_999 + " y", "x" * 8_000 + " y", " " * 8_001]
    out += ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(150)]
    out.append("".join(r.choice(letters.replace("<", "")) for _ in range(700_000)))
    return out


def test_fim_equals_brute_force(spark):
    rows = [(k if k % 17 else None, t, "clash") for k, t in enumerate(texts())]
    rows += rows[3:9]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    got = [tuple(r) for r in fill_in_middle.report(docs).collect()]
    assert sorted(got, key=repr) == sorted((fim_plain(k, t) for k, t, _ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_keeps_the_row_and_restores_the_text(spark):
    docs = spark.createDataFrame([(k, t, k, "form") for k, t in enumerate(texts()[:60])], "doc_id long, text string, n long, `a: b` string")
    out = fill_in_middle.fill_in_middle(docs)
    assert out.where(F.col("row.n") != F.col("row.doc_id")).count() == 0
    assert out.where(fill_in_middle.restored(F.col("output"), F.col("form")) != F.coalesce("row.text", F.lit(""))).count() == 0
    assert fill_in_middle.report(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())


PARTS = ["a", "ab", "the", " ", "  ", "=", "==", "-", "\n", "\t", "é", "漢字", "😀", "▁", "ing", "er", "in", "\u0301", "1", "0", " " * 17, "aaa", "<s>", "\0"]


def piece_texts():
    r = random.Random(4)
    out = [None, "", " ", "\n", "▁", "▁▁", "</s>", "<0x0A>", *texts()[:40]]
    out += ["".join(r.choice(PARTS[: r.randint(2, len(PARTS))]) for _ in range(r.randint(0, 90))) for _ in range(1500)]
    out += [lead + c * n + tail for n in (2, 3, 14, 15, 16, 17, 33, 47, 48, 49, 63, 64, 65, 130, 999) for c in (" ", "=", "a", "ab", "0") for lead in ("", "x") for tail in ("", "the", "\n")]
    out.append("".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40_000)))
    return out


def test_sentencepiece_equals_the_library(spark, library):
    rows = [(k if k % 19 else None, t, "clash") for k, t in enumerate(piece_texts())]
    rows += rows[5:9]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_bos=False, add_eos=True)
        want.append((k, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, sentencepiece_codec.report(docs).collect()), key=repr) == sorted(want, key=repr)
    assert sentencepiece_codec.encode(docs).where("row.ids = 'clash'").count() == len(rows)
    assert sentencepiece_codec.report(docs.limit(0)).count() == 0


def test_decode_of_any_ids_equals_the_library(spark, library):
    r = random.Random(6)
    pick = [lambda: r.randrange(32_000), lambda: r.randrange(260), lambda: r.choice([29871, 259, 0, 1, 2, 229, 153, 132])]
    rows = [(k, [r.choice(pick)() for _ in range(r.randint(0, 9))]) for k in range(3000)] + [(3000, None)]
    got = {x.row.k: x.decoded for x in sentencepiece_codec.decode(spark.createDataFrame(rows, "k long, ids array<int>")).collect()}
    assert got == {k: library.decode(i or []) for k, i in rows}


def test_words_merge_alike_alone_and_together(library):
    model = sentencepiece_codec.model_of(sentencepiece_codec.default_model())
    encoder = sentencepiece_codec.Encoder(model)
    many = [t or "" for t in piece_texts()]
    flat, sizes = encoder.encode(many)
    assert flat.tolist() == [i for t in many for i in library.encode(t)] and sizes.tolist() == [len(library.encode(t)) for t in many]
    assert [len(x) for x in encoder.encode([""])] == [0, 1]


GOES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {2: "user", 3: "assistant"}


def repair_plain(rows):
    """(role, text, fault) in order -> least (cost, audit) and its lines, by one state after another."""
    best = {0: (0, "", ())}

    def add(now, state, element):
        now[state] = min(now.get(state, element), element)

    def inserted(now):
        for _ in range(3):
            for state, (cost, audit, out) in list(now.items()):
                for initial in "ua":
                    if state in GOES[initial]:
                        to = GOES[initial][state]
                        add(now, to, (cost + 5, audit + "I", (*out, ROLE[to] + ":")))
        return now

    for role, text, fault in rows:
        now = {}
        for state, (cost, audit, out) in inserted(best).items():
            add(now, state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            to = GOES.get(role[:1], {}).get(state)
            if to is not None:
                add(now, to, (cost + extra, audit + "K", (*out, f"{role}:{text}")))
            for initial in "ua":
                if state in GOES[initial]:
                    to = GOES[initial][state]
                    add(now, to, (cost + 1 + extra, audit + "R", (*out, f"{ROLE[to]}:{text}")))
        best = now
    return min(e for state, e in inserted(best).items() if state in (0, 3))


def structure_plain(rows, hurt=True):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        held[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = []
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faulty = set(), []
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = repair_plain(faulty) if faulty else (0, "", ())
        out.append((conv, gaps, *(sum(f[2] == x for f in faulty) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def talks():
    r = random.Random(8)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    said = ["hi.", "what?", "well", "", " \n", None, "a.\n", "é!", "x" * 3000 + ".", "b. ", "c"]
    rows = [(c, r.choice([None, *range(-2, 9)]), r.choice(roles), r.choice(said)) for c in (None, *range(60)) for _ in range(r.randint(1, 9))]
    rows += [(100, 0, "user", "same.")] * 40 + [(100, 1, "assistant", "")] * 30 + [(101, None, None, None)] * 3
    rows += [(200, t, r.choice(roles[:5]), f"{r.randrange(400)}{r.choice('.?x')}") for t in range(900)]
    return rows


def test_structure_repair_equals_brute_force(spark):
    rows = talks()
    turns = spark.createDataFrame([(*t, "clash") for t in rows], "conv_id long, turn long, role string, text string, cost string").repartition(5)
    got = structure_repair.report(turns)
    assert sorted(map(tuple, got.collect()), key=repr) == structure_plain(rows)
    assert structure_repair.report(turns.limit(0)).count() == 0


def test_structure_repair_over_many_chunks(spark, monkeypatch):
    # Chunks of four turns in groups of two partitions: the conversation of 900 goes through all three levels.
    monkeypatch.setattr(structure_repair, "CHUNK", 2)
    monkeypatch.setattr(structure_repair, "GROUP", 34)
    rows = [t for t in talks() if t[0] in (100, 101, 200)]
    repairs = structure_repair.Repairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    counts = {r.conv_id: tuple(r)[1:7] for r in repairs.conversations().collect()}
    digests = {int(r.conv[1:]): tuple(r)[1:] for r in repairs.digests().collect()}
    assert sorted(((c, *counts[c], *digests[c]) for c in counts), key=repr) == structure_plain(rows, hurt=False)
    turns = repairs.turns().collect()
    added = {r.conv_id: r.added for r in repairs.conversations().collect()}
    for conv in counts:
        mine = sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.place)
        assert "".join(t.audit for t in mine) + "I" * added[conv] == digests[conv][0]
        lines = [f"{x.role}:{x.text}" for t in mine for x in t.repaired] + ["user:", "assistant:"][2 - added[conv] :]
        assert sha("\n".join(lines)) == digests[conv][1]
        assert sum(t.copies for t in mine) == sum(x[0] == conv for x in rows)


CLASH = "doc_id long, text string, source string, hits string, _row string, _cuts string, _block string, _doc string, `size` string, _in string, shard string"


def test_stages_keep_columns_by_value(spark):
    from quern.llm import decontamination, mixing, sharding

    rows = [(k, f"words of the text number {k} and more " * (k % 5 + 1), "ab"[k % 2], *[f"{c}{k}" for c in "hrcbdsin"]) for k in range(40)]
    docs = spark.createDataFrame(rows, CLASH)
    bench = spark.createDataFrame([(1, "words of the text number 7 and more")], "item_id long, text string")
    kept = decontamination.decontaminate(docs, bench).collect()
    assert sorted(map(tuple, kept)) == [r for r in rows if r[0] != 7]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(rows)
    sharded = sharding.shard(docs)
    assert sharded.columns == [*docs.columns[:-1], "shard", "slot"] and sorted(tuple(r)[:-2] for r in sharded.collect()) == [r[:-1] for r in rows]


def nearest(sizes, target):
    """Least |sum - target| of at most two copies of each."""
    sums = {0}
    for size in sizes:
        sums = {s + k * size for s in sums for k in (0, 1, 2)}
    return min(abs(s - target) for s in sums)


def test_mixing_comes_near_its_targets(spark):
    from quern.llm import mixing

    r = random.Random(2)
    sources = {"dealt": [46, 141, 142, 150, 189, 243, 261, 372, 453, 2065], "huge": [500, 3, 4, 5], "even": [100] * 30, "one": [70], "large last": [9, 8, 7, 300, 310, 290]}
    sources |= {f"r{k}": [r.choice([3, 20, 90, 700]) for _ in range(r.randint(1, 8))] for k in range(14)}
    rows = [(k, "w " * n, s) for k, (s, n) in enumerate((s, n) for s, sizes in sources.items() for n in sizes)]
    got = defaultdict(list)
    for x in mixing.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        got[rows[x.doc_id][2]].append(x)
    for s, sizes in sources.items():
        target, taken = got[s][0].target, sum(x.taken for x in got[s])
        assert all(x.taken in (0, x["size"], 2 * x["size"]) for x in got[s])
        assert abs(taken - target) <= max(min(sizes), 0.02 * target, 2 * nearest(sizes, target)), (s, target, taken, nearest(sizes, target))


def test_replies_are_ordered_depth_first(spark):
    from quern.llm import quotation

    says = {0: "The first message of all goes here", 1: "Child one has its own words too", 2: "Child two says another thing now", 3: "Grandchild of one answers that well", 4: "Child three comes late to this", 5: "Great grandchild is the last word"}
    parent = {1: 0, 2: 0, 3: 1, 4: 0, 5: 3}
    rows = [(1, t, "user", (f"> {says[parent[t]]}\n\n" if t in parent else "") + says[t]) for t in says] + [(2, 0, "user", "Alone here without any quotes")]
    # A stock phrase that two messages of other conversations hold, and one that a single message holds.
    rows += [(3, 0, "user", "Thanks for the help"), (4, 0, "user", "Thanks for the help"), (5, 0, "user", "> Thanks for the help\n\nno parent then"), (6, 0, "user", "> Alone here without any quotes\n\nfound it there")]
    got = {(x.conv_id, x.turn): x for x in quotation.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert {t: got[1, t].parent_turn for t in says} == {0: None} | parent
    assert sorted(says, key=lambda t: got[1, t].position) == [0, 1, 3, 5, 2, 4] and [got[1, t].position for t in (0, 1, 3, 5, 2, 4)] == list(range(6))
    assert got[5, 0].parent_conv is None and (got[6, 0].parent_conv, got[6, 0].thread_conv, got[6, 0].position) == (2, 2, 1) and got[2, 0].position == 0


def test_quotation_of_long_threads_ties_and_empty_tables(spark):
    from quern.llm import quotation

    line = lambda t: f"Message number {t} with words of its own"
    rows = [(1, t, "user", (f"> {line(t - 1)}\n\n" if t else "") + line(t), "x") for t in range(60)]
    rows += rows[10:12] + [(None, 1, "user", None, "x"), (2, None, None, "> " + line(3), "x"), (2, 0, "user", "long " * 50_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string").repartition(4)
    got = quotation.link_quotations(df).collect()
    assert len(got) == len(rows) and all(x.position == x.depth == x.turn for x in got if x.conv_id == 1)
    assert all(x.position == 0 and x.parent_conv is None for x in got if x.conv_id != 1)
    assert quotation.link_quotations(df.limit(0)).count() == 0


def test_the_target_model_counts_all_labelled_documents(spark, monkeypatch):
    from quern.llm import lm_scoring

    docs = spark.createDataFrame([(k, f"a{k % 4} b{k % 3} c{k} a{k % 5}") for k in range(24)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(24)], "doc_id long, quality int, toxic int")
    scores = lambda: {r.doc_id: round(r.score, 9) for r in lm_scoring.lm_scores(docs, labels).collect()}
    want = scores()
    monkeypatch.setattr(lm_scoring, "TARGETS", 2)
    assert scores() == want and len(set(want.values())) > 1


def test_release_drops_the_shuffle_files_of_what_is_gone(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    common.release(spark)
    time.sleep(2)
    for _ in range(4):
        before = files()
        common.stash(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
        assert files() > before
        common.release(spark)
        # Spark drops the files itself, a moment later.
        time.sleep(0.5)
        assert files() <= before


def test_words_are_hashed_a_few_texts_at_a_time(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from quern.llm import wordhash

    texts = pa.array([None, "", "Ab c", " \n", *[f"word{k} of a text " * 400 for k in range(1200)], None])
    tracemalloc.start()
    words, at = wordhash.word_hashes(texts, lower=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * texts.nbytes
    monkeypatch.setattr(wordhash, "_BYTES", 1)
    one, of = wordhash.word_hashes(texts, lower=True)
    assert np.array_equal(one, words) and np.array_equal(of, at) and at[-1] == len(words) == 1200 * 1600 + 2
