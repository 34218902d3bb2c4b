"""Token counts: what goes to the library whole, and what a worker keeps."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rillweave.llm import token_counts as tc

DEFINITION = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def table(tokens=()):
    plain = Tokenizer.from_str(DEFINITION)
    return tc.LengthTable.of(list(tokens), [len(plain.encode(t, add_special_tokens=False)) for t in tokens])


def test_odd_characters_send_only_their_stretch(monkeypatch):
    plain, draw = Tokenizer.from_str(DEFINITION), random.Random(3)
    counter = tc.TokenCounter(DEFINITION, table(["the", " the"]), 1 << 20)
    whole, old = [], counter.tokenizer

    class Watched:
        def encode(self, text, **options):
            whole.append(len(text))
            return old.encode(text, **options)

        def encode_batch(self, texts, **options):
            return old.encode_batch(texts, **options)

    counter.tokenizer = Watched()
    odd = ["\U0001f680", "\U0001f923", "ไทย", "ಕನ್ನಡ", "՘", "🙂"]
    say = lambda n: " ".join("".join(draw.choices("abcdefgh'é. \n0123", k=draw.randint(1, 9))) for _ in range(n))
    for i in range(60):
        parts = [say(draw.randint(0, 300)) for _ in range(4)]
        text = draw.choice(odd).join(parts) if i % 2 else (draw.choice(odd) + draw.choice([" ", "\n", "  ", "x", "<|endoftext|>"])).join(parts)
        whole.clear()
        assert counter.count(text) == len(plain.encode(text, add_special_tokens=False))
    whole.clear()
    text = "plain words and numbers 12 " * 4000 + "\U0001f680" + " more of the plain words" * 4000
    assert counter.count(text) == len(plain.encode(text, add_special_tokens=False))
    assert len(whole) == 1 and whole[0] < 1000 and " plain" in counter.young
    assert counter.count("ไทย" * 5000) == len(plain.encode("ไทย" * 5000, add_special_tokens=False))


def test_stretches_end_where_pre_tokens_do():
    draw = random.Random(8)
    for _ in range(300):
        text = "".join(draw.choices("ab9 '\n.é\U0001f680s", k=700))
        cuts, at = [0], 0
        while found := tc._STRETCH.match(text, at):
            at = found.end()
            cuts.append(at)
        parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
        assert [t for p in parts for t in tc.PRE_TOKEN.findall(p)] == tc.PRE_TOKEN.findall(text)


def test_counter_of_a_worker_outlives_a_task(spark):
    one = tc.worker_counter(DEFINITION, table(), 1 << 20)
    one.count("some words")
    assert tc.worker_counter(DEFINITION, table(["x"]), 1 << 20) is one and one.young and len(one.frequent.high) == 1
    assert tc.worker_counter(DEFINITION, table(), 1 << 19) is not one
    shared = spark.sparkContext.broadcast((DEFINITION, table()))

    def run(frames):
        import os

        counter = tc.worker_counter(*shared.value, 1 << 20)
        for f in frames:
            had = len(counter.young)
            for i in f["id"]:
                counter.count(f"word{i} again")
            yield f.assign(pid=os.getpid(), had=had)

    got = spark.range(0, 40, 1, 40).mapInPandas(run, "id long, pid long, had long").collect()
    later = [r.had > 0 for r in got]
    # Forty tasks in a few workers: most find what an earlier task has kept.
    assert sum(later) >= 40 - 2 * len({r.pid for r in got}) and len({r.pid for r in got}) < 20


@pytest.mark.parametrize("longest", [1 << 10])
def test_cache_stays_within_its_bytes(longest):
    counter = tc.TokenCounter(DEFINITION, table(), 100_000)
    for i in range(4000):
        counter.count(f"word{i} " + "y" * (i % longest))
    assert sum(120 + 2 * len(t) for held in (counter.young, counter.old) for t in held) <= 100_000 + 2 * (120 + 2 * 256)
