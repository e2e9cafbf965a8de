import base64
import random
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from statforge.llm import neardup, quality, tokens
from statforge.llm.tokens import DEFAULT_VOCABULARY, Transducer, composed, token_counts

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def reference():
    with open(DEFAULT_VOCABULARY, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return data, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_those_of_the_encoder():
    data, encoder = reference()
    rnd = random.Random(5)
    alphabet = " \n\t'stmdrvleaABé1 2-_  ''ß漢字 😀"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 3, 10, 50, 2500]))) for _ in range(500)]
    texts += ["a" * 5000, " " * 5000, "don't we're" * 700, "-" * 3000, "thereinthe" * 900, "\n \n" * 900, "'", "''s", "x're y'LL"]
    machine = Transducer(data)
    assert machine.count(texts).tolist() == [len(encoder.encode_ordinary(t)) for t in texts]


def test_dropping_the_automaton_changes_no_count(monkeypatch):
    data, encoder = reference()
    rnd = random.Random(7)
    noise = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") for _ in range(30_000))
    texts = [noise, "the quick brown fox " * 900, noise[:4000] + " x " + "don't " * 1500, "日本語のテキスト" * 1500, "", " " * 9000]
    monkeypatch.setattr(tokens, "MOST_STATES", 300)
    monkeypatch.setattr(tokens, "PART", 5000)
    machine = Transducer(data)
    assert machine.count(texts).tolist() == [len(encoder.encode_ordinary(t)) for t in texts]
    assert len(machine.states) < 5000


def test_tables_of_found_results_stay_small(monkeypatch):
    data, encoder = reference()
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefgh ij0123_ÄÖ漢") for _ in range(20_000))
    monkeypatch.setattr(tokens, "MOST_FOUND", 300, raising=False)
    machine = Transducer(data)
    assert machine.count([text]).tolist() == [len(encoder.encode_ordinary(text))]
    assert max(len(machine.merges.next), len(machine.merges.open), len(machine.merges.pair)) <= 300


@pytest.mark.parametrize("module", [neardup, quality])
def test_other_operators_drop_the_automaton_of_a_worker(spark, monkeypatch, module):
    rows = MagicMock()
    rows.select.return_value = rows
    monkeypatch.setattr(module, "only", lambda *_, **__: rows)
    if module is neardup:
        module.signed(None, "doc_id", "text", 64, 3)
    else:
        module.scored(None, (0.0,) * quality.FEATURES)
    tokens.compiled(reference()[0])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "th": [3, 4], "text": ["some words here", None]})
    assert sum(b.num_rows for b in rows.mapInArrow.call_args[0][0](iter([batch]))) == 2
    assert not tokens._compiled


def test_maps_compose_like_a_chain():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (2, 2), (37, 3), (64, 2)):
        domain = np.array([rng.permutation(5)[:k] for _ in range(n)])
        end, constant = rng.integers(-1, 5, (n, k)), rng.random(n) < 0.1
        constant[0] = True
        slot = 0
        got = composed(domain, end, constant).tolist()
        for i in range(n):
            if constant[i]:
                slot = 0
            elif slot >= 0:
                at = np.flatnonzero(domain[i] == end[i - 1, slot]) if end[i - 1, slot] >= 0 else []
                slot = int(at[0]) if len(at) else -1
            assert got[i] == slot


def test_other_vocabulary():
    path = DEFAULT_VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    with open(path, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    encoder = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Größe und Übermut", "la ciudad más bonita", "The end."]
    assert Transducer(data).count(texts).tolist() == [len(encoder.encode_ordinary(t)) for t in texts]


def test_odd_rows(odd, empty):
    _, encoder = reference()
    got = token_counts(odd).collect()
    want = [(r.doc_id, None if r.text is None else len(encoder.encode_ordinary(r.text))) for r in odd.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts(empty).count() == 0


def test_no_texts():
    assert Transducer(reference()[0]).count([]).tolist() == []
    assert np.array_equal(Transducer(reference()[0]).count(["", ""]), [0, 0])
