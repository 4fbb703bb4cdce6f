"""Languages in several scripts, and judgements against a slow out-of-place distance."""

import random
from collections import Counter

import pytest

from duelframe.llm import language_id as li

ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöùúûüýþðøąćęłńśźżčďěňřšťůž",
    "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "zh": "".join(map(chr, range(0x4E00, 0x4E80))),
    "ja": "".join(map(chr, range(0x3042, 0x3090))),
}


def words(rng, letters, n=40):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    rows, own = [], {lang: words(rng, letters) for lang, letters in ALPHABETS.items()}
    for lang, count in (("latin", 300), ("ru", 60), ("el", 60), ("zh", 60), ("ja", 60)):
        rows += [(" ".join(rng.choices(own[lang], k=25)), lang) for _ in range(count)]
    rng.shuffle(rows)
    return [(k, text, lang) for k, (text, lang) in enumerate(rows)]


def test_every_script_is_told_apart(spark, docs):
    found = li.identify_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string")).where("held_out").collect()
    truth = {k: lang for k, _, lang in docs}
    assert len(found) > 80 and all(r.lang_pred == truth[r.doc_id] for r in found)


def slow_grams(text):
    count: Counter = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        edged = f" {word} "
        for n in range(1, li.MAX_N + 1):
            count.update(g for g in (edged[k : k + n] for k in range(len(edged) - n + 1)) if g != " ")
    return count


def key_of(gram):
    """The key under which an n-gram is counted, from a text that holds no other one of its length and edges."""
    value = 0
    for n, c in enumerate(gram, 1):
        point = 0 if c == " " else ord(c)
        if n == 4:
            value = int(li.mixed(li.np.array([value], li.np.uint64))[0]) % 2**64
        value = point + 1 if n == 1 else (value * (0x10FFFF + 4) + point + 1) % 2**64
    return int(li.mixed(li.np.array([value], li.np.uint64))[0])


def slow_rank(count):
    return sorted(count, key=lambda g: (-count[g], key_of(g)))[: li.PROFILE]


def test_judgements_against_a_slow_distance(spark, docs):
    profiles = li.learn_profiles(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    ranked = {}
    for lang in ALPHABETS:
        total: Counter = Counter()
        for _, text, own in docs:
            if own == lang:
                total.update(slow_grams(text))
        ranked[lang] = {g: k for k, g in enumerate(slow_rank(total))}
    for _, text, _ in docs[:40]:
        top = slow_rank(slow_grams(text))
        away = {
            lang: sum(min(abs(rank[g] - k), li.PROFILE) if g in rank else li.PROFILE for k, g in enumerate(top)) for lang, rank in ranked.items()
        }
        best = min(sorted(away), key=away.get)
        assert li.judge(text, profiles) == (best, pytest.approx(1 - away[best] / (li.PROFILE * len(top))))


def test_counts_are_added_up_as_they_come(monkeypatch):
    """However many texts are counted, no more waits than HELD_GRAMS or what is added up already; the sums are those of all."""
    monkeypatch.setattr(li, "HELD_GRAMS", 500)
    rng, letters = random.Random(8), li.letter_mask()
    texts = [" ".join(words(rng, ALPHABETS["latin"][:8], 30)) for _ in range(200)] + ["", "1 2", "é"]
    held, want, most = li.GramTotals(), Counter(), 0
    for text in texts:
        keys, counts = li.count_grams(li.letters_of(text, letters))
        held.add(keys, counts)
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        most = max(most, sum(len(k) for k, _ in held.found))
    keys, counts = held.sums()
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (li.np.diff(keys) > 0).all()
    assert most <= 2 * len(want) + 1500
    assert [len(part) for part in li.GramTotals().sums()] == [0, 0]
