"""Operators 11 to 13 against brute force: whole small tables with odd rows, and single functions on random texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ferrule.llm import align, bpe, infill
from tests.llm.test_operators import random_texts

SCHEMA = "doc_id long, text string, ids string, row string, form string, n long"
PARTS = ["a", "s", "'", "t", "re", " ", "  ", "\n", "\t", " ", "　", "1", "²", "é", "漢字", "🙂", "!", "{", "}", "\x1c", "\x85", "<|endoftext|>", "<|", "Q", "zx", "_", "́", "'ll", "'VE", "qj", "\x00", "▁", "<s>", "<P>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Random texts, texts of odd characters, nulls, empties, repeated rows, a null doc_id, marks, very long texts, and extra columns with clashing names."""
    rnd = random.Random(5)
    texts = random_texts(4, 40) + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 40))) for _ in range(200)]
    texts += [None, "", " ", "letters" * 5000, "one two three " * 20_000, "\n" * 3000 + "x", "é漢🙂a b" * 4000, "mark <M> here", "0123456789" * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "the lone text of none"), (None, None)]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def brute_infill(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = sha(f"1:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return doc, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_infill(spark, folder):
    got = Counter(tuple(r) for r in infill.op11_fill_in_middle(spark, folder[0]).collect())
    assert got == Counter(brute_infill(*r) for r in folder[1])
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_cut_places_in_blocks_of_any_size(block):
    rnd = random.Random(block)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "bc", "é", "漢", "🙂", " ", "\n", "Z", "longer"]) for _ in range(rnd.randint(0, 60)))
        begins = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
        tree = infill.BlockTree(text.encode(), block)
        assert (tree.units, tree.chars) == (len(begins) - 1, len(text))
        assert [tree.begin(k) for k in range(len(begins))] == [(len(text[:x].encode()), x) for x in begins]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe(spark, folder, library):
    want = Counter()
    for doc, text in folder[1]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.op13_forced_boundary_bpe(spark, folder[0]).collect()) == want


def test_bpe_of_random_characters_and_ids(library):
    rnd, encoder = random.Random(3), bpe.ForcedEncoder(bpe.Vocabulary())
    for _ in range(3000):
        text = "".join(rnd.choice(PARTS) if rnd.random() < 0.5 else chr(rnd.choice((rnd.randrange(0x20, 0x3000), rnd.randrange(0x3000, 0xD800), rnd.randrange(0xE000, 0x20000)))) for _ in range(rnd.randint(0, 30)))
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.text(np.array([50257, -1, 10**6, 64])) == "a"
    for _ in range(300):  # ids that are the encoding of nothing, with bytes that are no UTF-8
        ids = [rnd.randrange(50257) for _ in range(20)]
        assert encoder.text(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_borders_and_long_runs(library):
    vocabulary = bpe.Vocabulary()
    for token in vocabulary.bytes_of.values():
        assert not any(vocabulary.never[256 * a + b] for a, b in zip(token, token[1:]))
    encoder = bpe.ForcedEncoder(vocabulary)
    for text in (" " * 300_000, ("\n" * 19_999 + "a") * 10, "ab" * 100_000, "='" * 100_000, "x" + "　" * 20_000 + "y"):
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for piece in (b"thethethe" * 30, b" " * 300, "é".encode() * 99):
        assert vocabulary.merge(piece) == vocabulary._merge_long([vocabulary.byte_ids[x] for x in piece])


def test_bpe_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = bpe.ForcedEncoder(bpe.Vocabulary())
    text = " ".join(f"word{k} more{k * k}" for k in range(200))
    assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids and len(encoder._known) <= 5


def brute_align(library, pieces, text):
    """(groups, links) by the offsets where tokens of both sides end."""
    if not text:
        return [], []
    library.encode_special_tokens = True
    a = library.encode(" " + text, add_special_tokens=False).ids
    library.encode_special_tokens = False
    of = bpe.byte_characters()
    a_bytes = [bytes(of[c] for c in library.id_to_token(i)) for i in a]
    b = pieces.encode(text)
    b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return [], []
    ends = [dict(zip(np.cumsum([len(x) for x in side]).tolist(), range(1, len(side) + 1))) for side in (a_bytes, b_bytes)]
    out, links, i, j = [], [], 0, 0
    for end in sorted(ends[0].keys() & ends[1].keys()):
        m, n = ends[0][end], ends[1][end]
        out.append((a[i:m], b[j:n]))
        links.append((a[m - 1], b[n - 1]))
        i, j = m, n
    return out, links


def test_alignment(spark, folder, library):
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = [(doc, *brute_align(library, pieces, text)) for doc, text in folder[1]]
    counts = Counter(x for _, _, links in found for x in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter()
    for doc, groups, links in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        want[doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(text) if groups else ""] += 1
    assert Counter(tuple(r) for r in align.op12_token_alignment(spark, folder[0]).collect()) == want
    assert sum(not r[1] for r in want) > 5 and sum(r[3] > 0 for r in want) > 50
    by_id = {doc: groups for doc, groups, _ in found}
    for r in align.align(spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 60")).collect():
        made = defaultdict(lambda: ([], []))
        for side, ids, numbers in ((0, r.a_ids, r.a_groups), (1, r.b_ids, r.b_groups)):
            for i, g in zip(ids, numbers, strict=True):
                made[g][side].append(i)
        assert [made[g] for g in sorted(made)] == by_id[r.doc_id]


def test_pairs_are_bounded_by_the_vocabularies(spark, folder):
    aligner = align.Aligner()
    assert align.pair_bound(aligner) == 324_300
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for r in align.pair_counts(align.align_links(docs)).collect():
        a, b = aligner.vocabulary.bytes_of[r.pair // align.PAIR], aligner.pieces.bytes_of[r.pair % align.PAIR]
        assert a.endswith(b) or b.endswith(a)


def test_pointers_double_over_long_chains():
    """Tokens of both sides that overlap in one chain of 100,000, then a shared end."""
    n = 50_000
    a, b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n, 2), 2 * n)
    group_a, group_b, last_a, last_b = align.groups(a, b)
    assert not group_a.any() and not group_b.any() and last_a.tolist() == [len(a) - 1] and last_b.tolist() == [len(b) - 1]


@pytest.mark.parametrize("query", [infill.op11_fill_in_middle, align.op12_token_alignment, bpe.op13_forced_boundary_bpe])
def test_an_empty_table_gives_no_rows(spark, no_rows, query):
    assert query(spark, no_rows).count() == 0
