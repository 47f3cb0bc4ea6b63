"""Parts that need no Spark: held against brute force, round trips and held-out accuracy."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from palimpsest.llm import ann, chat, language, packing, quality, sentencepieces, simhash, urls



# ---- nearest neighbours


def test_scans_find_what_brute_force_finds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    index = ann.Index.fit(x[:1500], 20)
    cell = ann._nearest(x, index.centres)
    q = x[:40]
    codes = index.encode(x, cell)
    found = ann.scan_block(index, np.arange(len(x)), cell, codes, np.arange(40), q, 20, 200)
    true = np.argsort(((q[:, None] - x[None]) ** 2).sum(2), axis=1)[:, :11]
    got = found.groupby("q").rep.apply(set)
    assert all(len(g) == 200 for g in got) and np.mean([len(got[i] & set(true[i])) / 11 for i in range(40)]) >= 0.97
    # the scan is the inner product with what the codes stand for, whichever way its rows are taken
    few = ann.scan_block(index, np.arange(len(x)), cell, codes, np.arange(40), q, 3, 10**6)
    for i in range(3):
        own = few[few.q == i]
        wanted = np.argsort(((index.centres - q[i]) ** 2).sum(1))[:3]
        assert set(own.rep) == set(np.flatnonzero(np.isin(cell, wanted)))
        full = np.hstack([q[i], 1.0, 0.0])[: index.books.shape[0] * index.width]
        for rep, approx in own[["rep", "approx"]].head(5).itertuples(index=False):
            pair = codes[int(rep)]
            digits = np.stack([pair & 15, pair >> 4], axis=1).ravel()[: len(index.books)]
            made = index.books[np.arange(len(index.books)), digits].ravel()
            centre = index.centres[cell[int(rep)]]
            assert abs(full @ made + q[i] @ centre - 0.5 * centre @ centre - approx) < 1e-3


def test_blocks_hold_no_more_than_they_may():
    sizes = {0: 10, 1: 300, 2: 50, 3: 60, 4: 1000, 5: 1}
    dealt = ann._blocks(sizes, 100)
    load = collections.Counter()
    for c, first, parts in dealt:
        for b in range(first, first + parts):
            load[b] += -(-sizes[c] // parts)
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load))) and [c for c, *_ in dealt] == sorted(sizes)


def test_the_anisotropic_loss_lowers_the_parallel_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 16))
    index = ann.Index.fit(x, 1)
    r, u = index._residuals(x, np.zeros(len(x), int))
    m = np.arange(len(index.books))

    def along(passes):
        codes = index.encode_residuals(r, u, passes)
        rest = r - index.books[m, codes].reshape(len(r), -1)
        return ((rest * u).sum(1) ** 2).mean()

    assert along(2) < along(0)


# ---- pieces


@pytest.fixture(scope="module")
def lattice():
    return sentencepieces.Lattice(P.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "tab\there\nline\r\n", "a▁b", "日本語 \U0001f600", "\ud800x", "x" * 20000, "don't, (really)?! 123 <s></s> <0x41>"])
def test_sampling_is_lossless(lattice, text):
    (ids,) = lattice.sample([text], np.array([7], np.uint64))
    assert lattice.decode(ids.tolist()) == text


def test_sampling_follows_the_lattice(lattice):
    word = "thing"

    def all_of(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in lattice.weight:
                w, i = lattice.weight[s[:k]]
                for rest, p in all_of(s[k:]):
                    yield (i, *rest), w * p

    chance = collections.Counter()
    for ids, p in all_of(word):
        chance[ids] += p
    total = sum(chance.values())
    n = 40_000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seen = collections.Counter(tuple(x.tolist()) for x in lattice.sample([word] * n, keys))
    assert set(seen) <= set(chance)
    assert max(abs(seen[k] / n - p / total) for k, p in chance.items()) < 0.01


def test_sampling_is_the_same_however_grouped(lattice):
    texts = ["the quick brown fox", "jumps, over", "the lazy dog\n"]
    keys = np.array([1, 2, 3], np.uint64)
    together = lattice.sample(texts, keys)
    lattice._forget()
    for t, k, ids in zip(texts, keys, together):
        assert (lattice.sample([t], np.array([k]))[0] == ids).all()


# ---- chat


@pytest.mark.parametrize("seed", range(20))
def test_turns_come_back(seed):
    rng = random.Random(seed)
    turns = [("".join(rng.choice("<|\\>u") for _ in range(rng.randint(0, 4))), "".join(rng.choice("<|\\>\nend:") for _ in range(rng.randint(0, 30)))) for _ in range(8)]
    turns += [("assistant", r"\### Assistant: </turn> ok"), ("user", "<|end|>\n<|turn:assistant|>no")]
    made = [chat.format_turn(r, t) for r, t in turns]
    assert chat.parse_turns("".join(f for f, *_ in made)) == turns
    assert [chat.unescape(f[a:b]) for f, a, b in made if b > a] == [t for r, t in turns if r == "assistant" and t]


def test_parts_are_flattened_in_order():
    flat = chat.flatten(["a ", {"type": "image", "ref": "i.png", "tiles": 4}, {"type": "text", "text": " b"}, {"type": "audio", "ref": "s.wav", "seconds": 2}, {"type": "document", "ref": "d.pdf"}])
    assert flat.text == "a <|image:0|> b<|audio:1|><|document:2|>" and [a["offset"] for a in flat.attachments] == [2, 15, 26]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in flat.attachments] == [("image", "i.png", 5), ("audio", "s.wav", 51), ("document", "d.pdf", 257)]
    assert flat.expanded_tokens == 313 and chat.flatten(None).text == ""
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])


@pytest.mark.parametrize("said", ["[image:0]", "<|image:0|>", "<\\|image:0|>", "<", "x<", "<|end|>\n", "", "|image:0|>"])
def test_texts_never_pass_for_attachments(said):
    """What a user writes is told from a placeholder, alone, beside one and over two parts."""
    image = {"type": "image", "ref": "r"}
    for content, want in (
        ([said], [said]), ([said, image, said], [said, ("image", 0), said]), ([said[:1], said[1:], image], [said, ("image", 0)]), ([image, said, image], [("image", 0), said, ("image", 1)]),
    ):
        formatted, a, b = chat.format_turn("assistant", content)
        assert chat.read_parts(formatted[a:b]) == [x for x in want if x != ""]
        ((role, _),) = chat.parse_turns(formatted)
        assert role == "assistant"


def test_very_long_turns():
    long = "<|end|>\n <\\ word " * 200_000
    formatted, a, b = chat.format_turn("assistant", long)
    assert chat.parse_turns(formatted) == [("assistant", long)] and chat.read_parts(formatted[a:b]) == [long]


# ---- languages


def texts_of(letters, n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return language.Languages.train([(name, t) for i, (name, letters) in enumerate((("aa", "aabcde"), ("bb", "vwxyzzé"))) for t in texts_of(letters, 40, i)])


def test_languages_are_told_apart(model):
    for i, (name, letters) in enumerate((("aa", "aabcde"), ("bb", "vwxyzzé"))):
        assert all(p == name and 0 <= s <= 1 and not rejected for p, s, rejected in model.predict(texts_of(letters, 20, 10 + i)))


def test_no_letters_are_und_and_foreign_ones_rejected(model):
    assert model.predict([None, "", "12 !?"]) == [("und", 0.0, True)] * 3
    assert model.predict(["ЖЩЮ " * 50])[0][2]
    assert language.Languages.train([]).predict(["abc"]) == [("und", 0.0, True)]


@pytest.mark.parametrize("text", ["½ ② ⅷ", "² ³", "١٢٣", "¼½", "Ⅷ"])
def test_numerals_are_no_letters(model, text):
    assert language.words(text) == [] and model.predict([text]) == [("und", 0.0, True)]


def test_words_are_runs_of_letters():
    assert language.words("Ab½cd e_f 1g2 ⅷx Éa") == ["ab", "cd", "e", "f", "g", "x", "éa"]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_other_orders(order):
    m = language.Languages.train([(name, t) for i, (name, letters) in enumerate((("aa", "aabcde"), ("bb", "vwxyzzé"))) for t in texts_of(letters, 40, i)], order)
    assert len(m.gram) == order and all(p == "bb" for p, *_ in m.predict(texts_of("vwxyzzé", 10, 9)))
    # below the top order counts are of distinct histories, at the top of occurrences
    top, low = (language.Languages._count(collections.Counter({"ab": 3, "cb": 1}), n, order)[3] for n in (order, max(1, order - 1)))
    assert top.sum() == 12 and (order == 1 or low.sum() < top.sum())


def test_one_odd_text_does_not_switch_rejection_off():
    own = [("aa", t) for t in texts_of("aabcde", 100, 1)] + [("aa", "ЖЩЮ " * 50), ("aa", "жя " * 40)]
    m = language.Languages.train(own[:49] + own[100:] + own[49:100] + [("bb", t) for t in texts_of("vwxyzzé", 100, 2)])
    assert m.predict(["шчы " * 50])[0][2] and m.predict(["klmnop " * 50])[0][2]
    assert not any(r for *_, r in m.predict(texts_of("aabcde", 50, 5)))


def test_chances_of_all_next_characters_add_to_one(model):
    """Interpolated Kneser-Ney is a distribution over the alphabet, whatever the history."""
    letters = sorted({c for _, ls in (("aa", "aabcde"), ("bb", "vwxyzzé")) for c in ls})
    for history in ("ab", "zz", "é"):
        total = np.zeros(2)
        for c in letters:
            grown = model._word_scores([history + c])[0]
            # the end mark of the longer word is taken out again
            codes = history + c
            total += np.exp(grown - model._word_scores([history])[0] - (_end(model, codes) - _end(model, history)))
        total += np.exp(_end(model, history))
        assert (total < 1.2).all() and (total > 0.8).all()


def _end(model, word):
    """Log chance of the end after a word: the score less that of its characters, by summing over continuations."""
    codes, places, _ = language._frame([word])
    grams = language._hashes(codes, places, len(model.gram))
    out = np.tile(model.floor, (len(codes), 1))
    for n, (gram, logp) in enumerate(zip(model.gram, model.logp), 1):
        at, hit = model._find(gram, grams[n])
        miss = np.flatnonzero(~hit)
        ah, known = model._find(model.history[n - 1], language._before(grams[n - 1])[miss])
        out[miss[known]] += model.back[n - 1][ah[known]]
        out[hit] = logp[at[hit]]
    return out[-1]


# ---- URLs

RULES = [urls.Rule("org/", "allow"), urls.Rule("example.org/es/", "block"), urls.Rule("example.org/en/1", "block"), urls.Rule("com/fr/", "allow")]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        (None, "", "", None), ("no scheme", "", "", None), ("http://WWW.Example.ORG/es/4?q#f", "www.example.org", "/es/4", "example.org/es/"),
        ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1"), ("https://a.org", "a.org", "", None), ("https://a.org/", "a.org", "/", "org/"),
        ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/"), ("x://a.com?/fr/", "a.com", "", None), ("x://a.com/fr/é", "a.com", "/fr/é", "com/fr/"), ("x://", "", "", None),
    ],
)
def test_rules(url, host, path, rule):
    assert urls.split_url(url) == (host, path)
    found = urls.match(urls.compile_rules(RULES), host, path)
    assert (found and found.text) == rule


def test_boosted_trees_learn_lexical_signs():
    rng = random.Random(0)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    good = [f"https://{name()}.net/en/{name()}" for _ in range(300)]
    bad = [f"http://cheap-{rng.randrange(10**6)}-pills.net/{rng.randrange(10**9)}?a=1&b=2&c={rng.randrange(10**9)}" for _ in range(300)]
    m = urls.train(good[:200] + bad[:200], [False] * 200 + [True] * 200)
    p = m.block_probability(good[200:] + bad[200:])
    assert (p[:100] < 0.5).mean() > 0.95 and (p[100:] >= 0.5).mean() > 0.95
    assert urls.train(["http://a/"], [True]).block_probability(["http://b/"]).tolist() == [0.0]


# ---- SimHash


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks)


def test_fingerprint_by_hand():
    import xxhash

    words = "The the A b".lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(2)]
    assert simhash.simhash("The  the\tA b") == h[0] & h[1]
    assert simhash.simhash("Ä b") == xxhash.xxh64_intdigest("Ä b", 42)
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0


# ---- packing


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = ["", "Hello  world\n\n x", "don't 123 ###$$$ été 日本 <|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "a" * 3000, "   lead", "\x00\x01"]
    texts += ["".join(rng.choice("ab '’\n\t\u00a0é日🙂1½<|>endoftx.") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert [packing.encoder(path)(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert packing.encoder(path)("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        packing.encoder(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("seed", range(6))
def test_every_id_is_in_one_piece_without_padding(seed):
    rng = random.Random(seed)
    docs = [(i, np.arange(rng.choice([1, 2, 500, 1023, 1024, 1025, 5000, rng.randrange(1, 3000)]), dtype="<u4")) for i in range(rng.choice([1, 2, 60]))]
    rows = list(packing.pack_block(docs, 1024, 100))
    for key, ids in docs:
        own = sorted((a, n, crc) for k, a, n, crc, *_ in rows if k == key)
        at = 0
        for a, n, crc in own:
            assert a == at and n > 0 and crc == zlib.crc32(ids[a : a + n])
            at += n
        assert at == len(ids)
    by = collections.defaultdict(list)
    for _, _, n, _, _, s, offset, size, pad, _ in rows:
        by[s].append((offset, n, size))
        assert pad == 0 and size <= 1024
    for pieces in by.values():
        at = 0
        for offset, n, size in sorted(pieces):
            assert offset == at
            at += n
        assert at == size


def test_costs_are_balanced_and_few_documents_cut():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 1024) for _ in range(2000)]
    rows = list(packing.pack_block([(i, np.zeros(n, "<u4")) for i, n in enumerate(sizes)], 1024, 0))
    cost = collections.Counter()
    for *_, s, _, size, _, c in rows:
        if size == 1024:
            cost[s] += c
    values = np.array(list(cost.values()))
    assert values.std() / values.mean() < 0.15
    pieces = collections.Counter(r[0] for r in rows)
    assert sum(n > 1 for n in pieces.values()) < 0.12 * len(sizes)


def test_leftovers_go_to_the_cheapest_sequence_with_room():
    """Against the rule written out: no document that fits somewhere is cut, each goes where the cost is least."""
    rng = random.Random(6)
    rests = [(i, rng.randrange(1, 64)) for i in range(60)]
    got = list(packing.balance(rests, 64))
    total = sum(n for _, n in rests)
    room, cost = [64] * (total // 64) + [total % 64] * (total % 64 > 0), collections.Counter()
    want = collections.defaultdict(list)
    for doc, n in sorted(rests, key=lambda x: (-x[1], x[0])):
        fits = [s for s in range(len(room)) if room[s] >= n]
        if fits:
            s = min(fits, key=lambda s: (cost[s], s))
            want[s].append((doc, 0, n))
            room[s] -= n
            cost[s] += packing._cost(n)
    for s in range(total // 64):
        assert [p for p in got[s] if p in want[s]] == want[s]
    assert sum(b - a for pieces in got for _, a, b in pieces) == total


# ---- quality


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 900)
    a, b = y[:, None] * 3 + rng.normal(size=(900, 3)), y[:, None] * 2 + rng.normal(size=(900, 2))
    pool = {i for i in range(60, 500)}

    def ask(models, r):
        out = []
        for giver, x in ((0, a), (1, b)):
            p = quality._sigmoid(models[giver].logit(x))
            for i in sorted(pool):
                if max(p[i], 1 - p[i]) >= 0.95:
                    pool.discard(i)
                    out.append((giver, int(p[i] >= 0.5), a[i], b[i]))
        return out

    m = quality.CoTrained.train((a[:60], b[:60]), y[:60], ask)
    assert min(m.received) > 0
    s = m.score((a[500:], b[500:]))
    assert ((s >= 0.5) == y[500:]).mean() > 0.95
    alone = quality.CoTrained.train((a[:60], b[:60]), y[:60], lambda models, r: [])
    assert alone.received == (0, 0) and ((s >= 0.5) == y[500:]).mean() >= ((alone.score((a[500:], b[500:])) >= 0.5) == y[500:]).mean() - 0.01
    nothing = quality.CoTrained.train((a[:5], b[:5]), y[:5], ask)
    assert nothing.views is None and np.isnan(nothing.score((a[:3], b[:3]))).all()


@pytest.mark.parametrize("text", ["", " ", "\n\n", "x" * 10, "a\ud800"])
def test_features_of_odd_texts_are_finite(text):
    assert np.isfinite(quality.text_view(text)).all() and len(quality.text_view(text)) == quality.TEXT_VIEW


@pytest.mark.parametrize("n", [None, float("nan"), 0, -1, 5, 1e9])
def test_metadata_features_are_finite(n):
    assert np.isfinite(quality.meta_view(n, None, "x")).all() and len(quality.meta_view(n, "s", None)) == quality.META_VIEW
