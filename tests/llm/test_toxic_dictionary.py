import numpy as np

from lodestone.llm import toxicity


def labelled(rng, n, phrase):
    """Texts of the same ordinary words; phrase stands in the first half of them, and its words apart in the others."""
    vocabulary = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "ki", "lo") for b in ("n", "rt", "mes", "lian", "t")]
    out = []
    for k in range(2 * n):
        w = list(rng.choice(vocabulary, 40))
        at = int(rng.integers(0, 30))
        if k < n:
            w[at:at] = phrase
        else:
            for p in phrase:
                w.insert(int(rng.integers(0, len(w))), p)
        out.append(" ".join(w))
    return out[:n], out[n:]


def test_phrases_of_short_ordinary_words():
    """No word tells the labels apart, and none has four bytes; the phrase does."""
    toxic, ordinary = labelled(np.random.default_rng(1), 200, ["go", "to", "it", "as", "we", "do", "so", "up"])
    m = toxicity.fit(toxic[:150], ordinary[:150], 0.5).open()
    assert m.toxic
    assert m.score(toxic[150:]).mean() > m.score(ordinary[150:]).mean() + 0.1


def test_few_labels():
    toxic, ordinary = labelled(np.random.default_rng(2), 5, ["vile", "rotten", "scum"])
    m = toxicity.fit(toxic, ordinary, 0.5)
    assert m.toxic and np.isfinite(m.open().score(toxic + ordinary + [None, ""])).all()


def _sentences(rng, phrase, n):
    """Texts of the same words in any order, with the phrase's words together only in toxic ones."""
    words = [f"{a}{b}" for a in ("go", "back", "where", "you", "came", "from", "now", "then") for b in ("", "s", "er", "ing")]
    out = []
    for i in range(n):
        w = [words[int(k)] for k in rng.integers(len(words), size=60)]
        at = int(rng.integers(50))
        out.append(" ".join([*w[:at], *(phrase if i % 2 else rng.permutation(phrase)), *w[at:]]))
    return out


def test_phrases_of_ordinary_words_are_learned():
    """Every word is as frequent in both kinds of text: only their order tells. Where a window ends inside the
    phrase, its parts may not suffice."""
    rng = np.random.default_rng(6)
    phrase = ["go", "back", "where", "you", "came", "from"]
    texts = _sentences(rng, phrase, 800)
    toxic, ordinary = texts[1::2], texts[::2]
    model = toxicity.fit(toxic[:300], ordinary[:300], 0.5)
    assert b"where you came" in model.lexicon
    assert (model.score(toxic[300:]) >= 0.5).mean() > 0.75 and (model.score(ordinary[300:]) < 0.5).mean() > 0.9


def test_few_labels():
    """With none or one of a kind the score is the share of label 1; with a few, dictionaries are still made."""
    rng = np.random.default_rng(7)
    texts = _sentences(rng, ["go", "back"], 12)
    for toxic, ordinary in (([], texts), (texts[:1], texts[1:]), (texts, [])):
        assert np.allclose(toxicity.fit(toxic, ordinary, 0.3).score(["a b", "", None]), 0.3)
    model = toxicity.fit(texts[:3], texts[3:], 0.25)
    assert model.toxic and np.isfinite(model.score([*texts, "", None])).all()
