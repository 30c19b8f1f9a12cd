"""Alignment of tokenizers against whole-text encoding and interval overlap."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest

from boutline.llm import alignment
from boutline.llm.queries import QUERIES

from .conftest import SF

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*PATHS)


def encoded(aligner, text):
    """(ids, token bytes) of either side, of the whole text; None if a side changes the text."""
    if not text:
        return None
    a = aligner.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.model.encode(text)
    whole = (" " + text).encode()
    if b"".join(aligner.a.bytes[i] for i in a) != whole or b"".join(aligner.b.bytes[i] for i in b) != whole:
        return None
    return a, list(accumulate(len(aligner.a.bytes[i]) for i in a)), b, list(accumulate(len(aligner.b.bytes[i]) for i in b))


def brute(aligner, text):
    """(n_a, n_b, groups, links) by the byte ranges of all tokens."""
    found = encoded(aligner, text)
    if found is None:
        return 0, 0, [], []
    a, ends_a, b, ends_b = found
    cuts = [0, *sorted({*ends_a} & {*ends_b})]
    groups = [
        f"{','.join(map(str, a[bisect.bisect_right(ends_a, lo):bisect.bisect_right(ends_a, hi)]))}|{','.join(map(str, b[bisect.bisect_right(ends_b, lo):bisect.bisect_right(ends_b, hi)]))}"
        for lo, hi in zip(cuts, cuts[1:])
    ]
    links, j = [], 0
    for i, end in enumerate(ends_a):
        start = ends_a[i - 1] if i else 0
        while ends_b[j] <= start:
            j += 1
        k = j
        while k < len(b) and (ends_b[k - 1] if k else 0) < end:
            links.append((a[i], b[k]))
            k += 1
    return len(a), len(b), groups, links


def report(aligner, rows):
    found = [(doc, *brute(aligner, text)) for doc, text in rows]
    count, best = Counter(), defaultdict(int)
    for *_, links in found:
        count.update(set(links))
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(
        (
            (doc, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for doc, n_a, n_b, groups, links in found
        ),
        key=str,
    )


def rows_of(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_parts_give_what_whole_texts_give(aligner):
    rng = random.Random(4)
    alphabet = " \n\t\r abcdeé中😀'.,!1234   \x00\x1c 　▁<s>|endoftext́ßﬁ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(6000)]
    texts += ["<|endoftext|> a", "a<s>b </s>", "<0x41>", "a ▁b", " ", "\n", " \nx", "x \n\n y", "", "word " * 3000 + "x" * 9000]
    got = aligner(texts)
    for i, text in enumerate(texts):
        n_a, n_b, groups, links = brute(aligner, text)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        assert (got["n_a"][i], got["n_b"][i], got["n_groups"][i], got["n_links"][i], got["groups_sha256"][i]) == (n_a, n_b, len(groups), len(links), digest), text[:60]
        pairs = Counter(a * aligner.b.size + b for a, b in links)
        assert dict(zip(got["pair"][i].tolist(), got["times"][i].tolist())) == pairs


def test_table_equals_brute_force_however_many_pairs_are_shared(spark, aligner, odd, docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = report(aligner, rows)
    clashing = odd.selectExpr("*", "doc_id AS pair", "doc_id AS times", "text AS rest", "doc_id AS text_key")
    for frequent in (alignment.FREQUENT_PAIRS, 100, 0):
        assert rows_of(alignment.align_tokenizers(clashing, *PATHS, frequent)) == want
    assert alignment.align_tokenizers(odd.limit(0), *PATHS).collect() == []
    whole = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(QUERIES["op13_align_tokenizers"](spark, SF)) == report(aligner, whole)
