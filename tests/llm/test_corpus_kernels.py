"""Kernels of the corpus operators against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from foliant.llm import bpe, html_text, induced, licenses, packing, suffixes, toxicity


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(codec):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.fst.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["", " ", "a", "\n\n\t x", "the theory's 2nd naïve café 日本語 😀😀", " " * 5000, "ab" * 4000, "<|endoftext|>"]
    texts += ["".join(rng.choice(rng.choice(["ab c", "éü ñ語😀 \n", "aaaa", "the andingtion 's "])) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t)
        assert "".join(codec.decode_stream(ids[i : i + 1] for i in range(len(ids)))) == t


def test_transducer_equals_plain_merging(codec):
    rng = random.Random(6)
    for _ in range(300):
        piece = "".join(rng.choice("thenation é") for _ in range(rng.randint(1, 14))).encode()
        assert list(codec.fst.encode_piece(piece)) == codec.fst.merged(piece)


def test_utf8_automaton_equals_the_library():
    rng = random.Random(7)
    for _ in range(500):
        raw = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(rng.randint(0, 12)))
        s, out, at = bpe.Utf8Stream(), "", 0
        while at < len(raw):
            n = rng.randint(1, 3)
            out += s.feed(raw[at : at + n])
            at += n
        assert out + s.close() == raw.decode("utf-8", "replace")


def test_packed_ids_equal_the_tokenizer():
    import struct

    t = packing.PackedTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    for _ in range(400):
        s = "".join(rng.choice("abC'S'tRE ÉßÀªº²½\xa0\xad\n\t0129!?#<|>é̈İΣ日") for _ in range(rng.randint(0, 30)))
        ids = t.tokenizer.encode(s, add_special_tokens=False).ids
        assert t.packed([s])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_best_fit_keeps_items_apart_and_bounds_hold():
    rng = np.random.default_rng(9)
    for _ in range(60):
        lengths = rng.integers(1, 21, rng.integers(1, 40))
        bins, offsets, rooms = packing.best_fit_decreasing(lengths, 20)
        for b in range(len(rooms)):
            spans = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
            at = 0
            for o, n in spans:
                assert o == at
                at += n
            assert at == 20 - rooms[b] <= 20
        assert -(-lengths.sum() // 20) <= packing.lower_bound(lengths, 20) <= len(rooms)
    assert packing.lower_bound(np.array([11] * 7), 20) == 7 and packing.lower_bound(np.array([], np.int64), 20) == 0


def test_bound_never_exceeds_the_optimum():
    rng = random.Random(10)

    def optimum(items):
        for k in range(1, len(items) + 1):
            for places in itertools.product(range(k), repeat=len(items)):
                if all(sum(x for x, p in zip(items, places, strict=True) if p == b) <= 12 for b in range(k)):
                    return k

    for _ in range(25):
        items = [rng.randint(1, 12) for _ in range(rng.randint(1, 6))]
        assert packing.lower_bound(np.array(items), 12) <= optimum(items)


def ordered(t, symbols, room, most):
    """Suffixes in ascending order, and what each has in common with the one before."""
    with induced.Scratch(room) as scratch:
        parts = [(p.copy(), c.copy()) for p, c in induced.sorted_suffixes(t, symbols, scratch, most)]
        files = scratch.count
    position, common = (np.concatenate(x) for x in zip(*parts, strict=True))
    return position[::-1].tolist(), [0, *common[1:][::-1].tolist()], files


def test_suffixes_and_common_prefixes_in_any_memory():
    rng = random.Random(11)
    for case in range(250):
        n, symbols = rng.randint(0, 60), rng.choice([2, 3, 5, 40])
        t = [rng.randint(1, symbols - 1) for _ in range(n)]
        if case % 3 == 0 and n:
            t = (t[: rng.randint(1, 6)] * 40)[:n]
        t = np.array([*t, 0])
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for room, most in ((1 << 20, 200), (7, 200), (16, 5)):
            position, common, _ = ordered(t, symbols, room, most)
            assert position == order
            for a, b, c in zip(order[:-1], order[1:], common[1:], strict=True):
                x, y = [*t[a:].tolist(), -1], [*t[b:].tolist(), -2]
                assert c == min(most, next(k for k in range(len(t) + 1) if x[k] != y[k]))


def test_queues_go_to_disk():
    """A string of forty times the room in memory, with long repetitions."""
    rng = np.random.default_rng(13)
    once = rng.integers(1, 30, 20_000)
    t = np.concatenate([once, once, [0]])
    held, spilled = ordered(t, 31, 1 << 20, 200), ordered(t, 31, 1000, 200)
    assert held[:2] == spilled[:2] and held[2] == 0 and spilled[2] > 40
    assert sum(c >= 200 for c in held[1]) == 20_000 - 199


def test_repeated_windows(monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(suffixes, "GRAM", 8)
    for _ in range(80):
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(4)]
        texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 12))).encode() for _ in range(5)]
        text, start, count, value, again = suffixes.runs_of(texts, 40)
        windows = [(t, s + i) for t, s, c in zip(text, start, count, strict=True) for i in range(c)]
        assert sorted(windows) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 39)]
        for t, s, c, a in zip(text, start, count, again, strict=True):
            held = [texts[t][s + i : s + i + 40] for i in range(c)]
            assert a or len(set(held)) == len(held)
        every = Counter(t[s : s + 40] for t in texts for s in range(len(t) - 39))
        for t, flags in zip(texts, suffixes.repeated_windows(texts, 40, rng.choice([50, 1 << 20])), strict=True):
            assert flags[: max(0, len(t) - 39)].tolist() == [every[t[s : s + 40]] > 1 for s in range(max(0, len(t) - 39))]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(12)
    for n in (1, 2, 6):
        score, first = rng.normal(size=n) * 2, np.zeros(n, bool)
        first[0] = True
        first[n // 2] = True
        arc = tuple(rng.normal(size=4))
        total, hit = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(score[i] * y[i] for i in range(n)) + sum(arc[2 * y[i - 1] + y[i]] for i in range(n) if not first[i]))
            total, hit = total + w, hit + w * np.array(y)
        assert np.allclose(toxicity.marginals(score, first, arc)[0], hit / total)


def test_toxicity_learns_words_and_beginnings():
    rng = random.Random(13)
    plain = ["".join(rng.choice(["ba", "lo", "mi", "tu"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]

    def doc(bad):
        words = [rng.choice(plain) for _ in range(40)]
        if bad:
            words[rng.randrange(40)] = rng.choice(["zonkhead", "grumf" + rng.choice(["a", "en", "osty", "ik"])])
        return " ".join(words)

    labels = [i % 4 == 0 for i in range(600)]
    texts = [doc(b) for b in labels]
    model = toxicity.fit(texts[:450], labels[:450])
    scores, p, sizes = toxicity.Scorer(model).documents(texts[450:] + ["", "grumfest"])
    wrong = sum((s >= 0.7) != b for s, b in zip(scores, labels[450:], strict=False))
    assert wrong <= 3 and scores[-2] < 0.5 and scores[-1] > 0.5 and len(p) == sizes.sum()
    assert toxicity.Scorer(toxicity.fit(["a"], [False])).documents(["x"])[0][0] < 1e-6


def test_main_text():
    page = "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>'</script></head><body><header>Site</header><nav><ul><li><a href=/a>a</a><li><a href=/b>b</a></ul></nav><div class=ad>Buy</div><div id='cookie-notice'>Cookies</div><article><h1>Head &amp; line</h1><p>One <b>two\n three</b><br>four<p>F&uuml;nf &lt;six&gt;<div class='comments'>No</div></article><aside>Side</aside><footer>&copy;</footer>"
    assert html_text.main_text(page) == "Head & line One two three four Fünf <six>"
    assert html_text.main_text("") == "" and html_text.main_text("<body><p>cut <a hre") == "cut"
    bare = "<body><div class=menu><a>1</a><a>2</a></div><div><p>A long paragraph of running text, with words.</p><p>And another paragraph that follows it.</p></div><div class=footer>f</div>"
    assert html_text.main_text(bare) == "A long paragraph of running text, with words. And another paragraph that follows it."


def test_density_chooses_the_text():
    words = lambda k: " ".join(f"word{k} of running text" for _ in range(40))
    links = "".join(f"<li><a href=/{k}>link number {k}</a>" for k in range(12))
    body = f"<h1>Head</h1><p>{words(1)}</p><p>{words(2)}</p>"
    whole = f"Head {words(1)} {words(2)}"
    assert html_text.main_text(f"<body><div class=page><div class=left><ul>{links}</ul></div><div class=text>{body}</div></div><div class=bottom><ul>{links}</ul></div>") == whole
    assert html_text.main_text(f"<body><article><a href=/t>Teaser</a></article><div>{body}</div>") == whole
    assert html_text.main_text(f"<body><article>{body}</article><article>{body}</article>") == f"{whole} {whole}"


def test_article_parts_stay():
    links = "".join(f"<li><a href=/{k}>Reference {k}</a>" for k in range(4))
    page = f"<body><article><h1>Head</h1><section id='discussion'><h2 id='related-work'>Related</h2><p class='notice'>Text</p></section><h2 id='social-impact'>Impact</h2><ol class='related-work'>{links}</ol><div class='ads'>Buy</div><div class='social-share'>Share</div></article>"
    assert html_text.main_text(page) == "Head Related Text Impact Reference 0 Reference 1 Reference 2 Reference 3"


def test_licences():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.85)
    mit = licenses.TEMPLATES["MIT"]
    text = "the words of and. Released under the MIT License. more\n" + mit.replace("sublicense, ", "").upper() + " Released under the MIT licence, or Released under the MIT License."
    hits = [(h["license"], text[h["start"] : h["end"]]) for h in scanner.scan(text)]
    assert [h for h in hits if h[0] == "MIT-notice"][0][1] == "Released under the MIT License"
    assert sum(h[0] == "MIT-notice" for h in hits) == 2 and sum(h[0] == "MIT" for h in hits) == 1
    assert scanner.scan("nothing of the kind is in this text at all") == [] == scanner.scan("")
    assert licenses.align(list("abcXdef"), list("abcYdef")) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
