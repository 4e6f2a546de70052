from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from pagelathe.llm import passage_dedup as pd_
from pagelathe.llm.queries import op8_passage_dedup
from tests.llm import brute
from tests.llm.fixtures import documents, empty, sentence


def prose(rng: random.Random, sentences: int) -> str:
    return " ".join(sentence(rng, rng.randint(5, 16)).capitalize() + rng.choice(".!?") for _ in range(sentences))


def found(df):
    """id -> [(start_byte, end_byte, component, removed)]"""
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append((r["start_byte"], r["end_byte"], r["component_id"], r["removed"]))
    return out


def repeated_windows(rows: list[tuple[int, str]], n: int = 50) -> dict[int, set[int]]:
    """doc_id -> numbers of the words covered by runs of `n` words that another document holds too."""
    where = defaultdict(set)
    for i, t in rows:
        w = brute.words(t)
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add(i)
    out = defaultdict(set)
    for i, t in rows:
        w = brute.words(t)
        for k in range(len(w) - n + 1):
            if len(where[tuple(w[k : k + n])]) > 1:
                out[i].update(range(k, k + n))
    return out


def covered(text: str, spans) -> set[int]:
    """Numbers of the words inside the byte spans."""
    raw = text.encode()
    starts = [len(text[: m.start()].encode()) for m in brute.WORD.finditer(text)]
    ends = [len(text[: m.end()].encode()) for m in brute.WORD.finditer(text)]
    assert all(0 <= a < b <= len(raw) for a, b, *_ in spans)
    return {k for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if any(x <= a and b <= y for x, y, *_ in spans)}


def test_planted_passages(spark):
    """Passages in the middle of texts, without lines around them, and with other sentences before."""
    rng = random.Random(11)
    passages = [prose(rng, 9) for _ in range(6)]
    rows, held = [], {}
    for i in range(80):
        k = i % 8
        body = [prose(rng, rng.randint(2, 6)), prose(rng, rng.randint(2, 6))]
        if k < 6:
            held[i + 1] = k
            rows.append(f"{body[0]} {passages[k]} {body[1]}")
        else:
            rows.append(" ".join(body))
    got = found(pd_.passages(documents(spark, rows, clashing=False)))
    assert set(got) == set(held)
    for i, k in held.items():
        first = min(j for j, x in held.items() if x == k)
        assert {(c, r) for _, _, c, r in got[i]} == {(first, i != first)}
        raw = rows[i - 1].encode()
        told = " ".join(raw[a:b].decode() for a, b, _, _ in got[i])
        words = brute.words(passages[k])
        assert len(set(words) & set(brute.words(told))) >= 0.8 * len(set(words))


def test_near_copies_of_paragraphs(spark):
    """Paragraphs at 0.8 or more are linked, others not."""
    rng = random.Random(12)
    line = sentence(rng, 80)
    changed = line.split(" ")
    changed[40] = "another"
    far = line.split(" ")
    for k in range(0, 80, 8):
        far[k] = f"other{k}"
    rows = [f"{sentence(rng, 30)}\n{line}\n{sentence(rng, 30)}", f"{sentence(rng, 30)}\n{' '.join(changed)}\n{sentence(rng, 30)}", f"{sentence(rng, 30)}\n{' '.join(far)}"]
    got = found(pd_.passages(documents(spark, rows, clashing=False)))
    assert set(got) == {1, 2}
    assert [r for *_, r in got[1]] == [False]
    assert [(c, r) for _, _, c, r in got[2]] == [(1, True)]


def test_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(13)
    passage = prose(rng, 8)
    rows = [f"{prose(rng, 3)}\n{passage}\n{prose(rng, 2)}" if i % 3 == 0 else prose(rng, 6) for i in range(900)]
    got = found(pd_.passages(documents(spark, rows, clashing=False)))
    assert set(got) == {i + 1 for i in range(0, 900, 3)}
    assert sum(not r for spans in got.values() for *_, r in spans) == 1


def test_real_documents_against_all_windows(spark):
    """Runs of 50 words that two documents share, by brute force over a whole table, are covered."""
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want, got = repeated_windows(rows), found(op8_passage_dedup(spark, folder))
    texts = dict(rows)
    hit = {i: len(w & covered(texts[i], got[i])) / len(w) for i, w in want.items()}
    assert all(h > 0.5 for h in hit.values())
    assert sum(hit.values()) >= 0.95 * len(hit)
    # Documents without so much as 20 shared words in a row are left alone.
    shared = repeated_windows(rows, 20)
    assert not [i for i in got if i not in shared]


def test_awkward_rows(spark):
    docs = documents(spark)
    got = pd_.passages(docs).collect()
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in docs.collect()}
    assert all(r["start_byte"] < r["end_byte"] and r["component_id"] <= r["doc_id"] for r in got)
    assert {13, 14, 15} <= {r["doc_id"] for r in got}  # equal texts of 60 words


def test_every_paragraph_keeps_its_least_run():
    """`marks` by the definition: the least run of every PARAGRAPH words, inside each document only."""
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    first = np.array([0, 0, 150, 150, 169, 189, 400])
    at, keys = pd_.marks(hashes, first)
    runs = pd_.ngrams(hashes, pd_.SEED)
    want = set()
    for a, b in zip(first[:-1], first[1:], strict=True):
        for s in range(a, b - pd_.PARAGRAPH + 1):
            want.add(s + int(np.argmin(runs[s : s + pd_.PARAGRAPH - pd_.SEED + 1])))
    assert at.tolist() == sorted(want)
    assert (keys == runs[at]).all()
    # Repeated words: one mark for PARAGRAPH words.
    at, _ = pd_.marks(np.full(200, 7, np.uint64), np.array([0, 200]))
    assert at.tolist() == list(range(0, 193, pd_.PARAGRAPH))
    assert not len(pd_.marks(hashes[:19], np.array([0, 19]))[0])


def test_repeats_inside_one_document_do_not_count(spark):
    rng = random.Random(14)
    line = sentence(rng, 60)
    docs = spark.createDataFrame([(1, f"{line}\n{line}"), (1, line), (2, sentence(rng, 60))], "doc_id long, text string")
    assert pd_.passages(docs).collect() == []


def test_empty_table(spark):
    assert pd_.passages(empty(spark)).collect() == []


def planted(spark, passage_of, pairs: int = 40):
    """Found passages by document; pair k's passages are in documents 2k + 1 and 2k + 2, inside long lines."""
    rng = random.Random(15)
    rows = []
    for _ in range(pairs):
        rows += [f"{sentence(rng, 30)} {p} {sentence(rng, 30)}" for p in passage_of(rng)]
    return rows, found(pd_.passages(documents(spark, rows, clashing=False)))


def fresh_words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]


def test_near_copies_inside_longer_lines(spark):
    """60 words with one changed word (Jaccard 0.84), without a line of their own."""

    def passage(rng):
        words = fresh_words(rng, 60)
        return [" ".join(words), " ".join([*words[:30], "another", *words[31:]])]

    rows, got = planted(spark, passage)
    for k in range(1, len(rows), 2):
        assert {(c, r) for _, _, c, r in got[k]} == {(k, False)}
        assert {(c, r) for _, _, c, r in got[k + 1]} == {(k, True)}
        assert covered(rows[k], got[k + 1]) >= set(range(30, 90))


def test_near_copies_of_wrapped_paragraphs(spark):
    """100 words with two changed words (0.81), wrapped at other places."""

    def passage(rng):
        words = fresh_words(rng, 100)
        other = [*words[:33], "another", *words[34:66], "change", *words[67:]]
        return ["\n\n" + "\n".join(" ".join(w[i : i + n]) for i in range(0, 100, n)) + "\n\n" for w, n in ((words, 10), (other, 12))]

    rows, got = planted(spark, passage)
    for k in range(1, len(rows), 2):
        assert {(c, r) for _, _, c, r in got[k + 1]} == {(k, True)}
        assert covered(rows[k], got[k + 1]) >= set(range(30, 130))


def test_alignment_needs_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
    b = a.copy()
    b[45] = 1
    assert pd_.aligned(a, b) == [(0, 90, 0, 90)]
    b[[40, 50]] = 1
    assert sorted(pd_.aligned(a, b)) == [(0, 40, 0, 40), (51, 90, 51, 90)]
    assert pd_.aligned(a, np.concatenate([a[:60], b[40:42], a[60:]])) == [(0, 90, 0, 92)]
    assert pd_.aligned(a, a[:4]) == []


def test_short_exact_passages_are_followed_to_their_ends(spark):
    """Exact runs of 30 words that two documents share are whole, though their outer chunks differ."""
    rows, got = planted(spark, lambda rng: [" ".join(fresh_words(rng, 30))] * 2, 60)
    for k in range(1, len(rows), 2):
        assert {(c, r) for _, _, c, r in got[k + 1]} == {(k, True)}
        assert covered(rows[k], got[k + 1]) >= set(range(30, 60))


def earlier_runs(rows: list[tuple[int, str]], n: int) -> tuple[dict, dict]:
    """By document, words in runs of `n` words that an earlier document holds, and that a later one holds."""
    low, high = {}, {}
    for i, t in rows:
        w = brute.words(t)
        for k in range(len(w) - n + 1):
            run = tuple(w[k : k + n])
            low[run], high[run] = min(low.get(run, i), i), max(high.get(run, i), i)
    before, after = defaultdict(set), defaultdict(set)
    for i, t in rows:
        w = brute.words(t)
        for k in range(len(w) - n + 1):
            run = tuple(w[k : k + n])
            before[i].update(range(k, k + n) if low[run] < i else ())
            after[i].update(range(k, k + n) if high[run] > i else ())
    return before, after


def islands(numbers: set[int]) -> list[set[int]]:
    out: list[set[int]] = []
    for k in sorted(numbers):
        if out and k - 1 in out[-1]:
            out[-1].add(k)
        else:
            out.append({k})
    return out


def test_removed_words_of_a_whole_table_by_brute_force(spark):
    """Over every run of PARAGRAPH words of a table: all that an earlier document holds is removed, and all that
    is removed beyond such runs stands in a near copy, so that nearly all of its shingles are held earlier."""
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    texts, got = dict(rows), found(op8_passage_dedup(spark, folder))
    before, after = earlier_runs(rows, pd_.PARAGRAPH)
    holders = defaultdict(set)
    for i, t in rows:
        for g in brute.shingles(t, pd_.SIZE):
            holders[g].add(i)
    for i, text in rows:
        spans = [s for s in got.get(i, []) if s[3]]
        gone = covered(text, spans)
        for island in islands(before[i]):
            if len(island) >= pd_.PASSAGE_WORDS:
                assert island <= gone
        for one in spans:
            told = covered(text, [one])
            assert told & before[i]
            w = brute.words(text)
            runs = [tuple(w[k : k + pd_.SIZE]) for k in sorted(told) if k + pd_.SIZE - 1 in told]
            assert sum(min(holders[g]) < i for g in runs) >= 0.8 * len(runs)
            assert one[2] < i
        for one in (s for s in got.get(i, []) if not s[3]):
            assert covered(text, [one]) & after[i]
    # A component's least document is one of its own, and keeps a passage or takes part in one.
    assert {c for spans in got.values() for _, _, c, _ in spans} <= set(texts)


def test_removed_passages_of_copies_name_the_first(spark):
    """Exact copies: component, removal and span of each by the definition."""
    rng = random.Random(21)
    bodies = [" ".join(fresh_words(rng, 70)) for _ in range(5)]
    rows = [bodies[rng.randrange(5)] for _ in range(60)]
    got = found(pd_.passages(documents(spark, rows, clashing=False)))
    for i, t in enumerate(rows, 1):
        low = rows.index(t) + 1
        assert got.get(i, []) == ([(0, len(t), low, i != low)] if rows.count(t) > 1 else [])


def test_words_of_common_runs_alone_are_no_passage(spark):
    """Two documents that share a dozen words in a row have no paragraph in common."""
    rng = random.Random(22)
    common = " ".join(fresh_words(rng, 12))
    rows = [f"{' '.join(fresh_words(rng, 40))} {common} {' '.join(fresh_words(rng, 40))}" for _ in range(30)]
    assert found(pd_.passages(documents(spark, rows, clashing=False))) == {}
