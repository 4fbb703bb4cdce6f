"""License notices that stand close together, and notices broken over many lines."""

import random
import textwrap

from duelframe.llm import licenses

PARTS = "in er th on re ed ti st en an he or at ha nt ou ly ing tion wh es bleed".split()
SHORT = [w for w in licenses.WORDINGS if len(w[2]) < 60]


def sentence(draw: random.Random) -> str:
    words = ["".join(draw.choices(PARTS, k=draw.randint(1, 4))) for _ in range(draw.randint(8, 30))]
    return " ".join(words).capitalize() + "."


def test_every_notice_of_a_crowded_block():
    """Exact wordings are found whatever else the block holds."""
    scanner, draw = licenses.Scanner(), random.Random(7)
    for _ in range(400):
        picked = draw.sample(SHORT, 5)
        text = " ".join(w for notice in picked for w in (notice[2], sentence(draw), sentence(draw)))
        assert [m.license for m in scanner.matches(text)] == [notice[0] for notice in picked]


def test_exact_wordings_alone():
    for name, _, wording in licenses.WORDINGS:
        found = [m for m in licenses.Scanner().matches(f"Some words before. {wording} And some after.")]
        assert [(m.license, m.missing, m.added) for m in found] == [(name, 0, 0)]


def test_hard_wrapped_notices():
    """Lines end anywhere in a wording, plain or behind the signs of a comment."""
    for width in (24, 30, 40, 50, 60, 72):
        for name, _, wording in licenses.WORDINGS:
            for sign in ("", " * ", "# "):
                text = "Intro text.\n\n" + "".join(f"{sign}{line}\n" for line in textwrap.wrap(wording, width, break_long_words=False, break_on_hyphens=not sign)) + "\nAnd then more."
                assert [m.license for m in licenses.Scanner().matches(text)] == [name], (width, text)


def test_wrapped_notices_at_any_cut():
    """Long runs are cut in blocks; a wrapped wording is found wherever the cut falls."""
    scanner, wrapped = licenses.Scanner(), textwrap.fill(licenses.WORDINGS[4][2], 50)
    for n in range(0, licenses.MOST_WORDS + 40, 7):
        text = "license " + "word license\n" * (n // 2) + wrapped + "\nlicense of this word" * 200
        found = scanner.matches(text)
        assert [(m.license, m.missing, m.added) for m in found] == [("MIT", 0, 0)], n
        assert text[found[0].start : found[0].end] == wrapped[:-1]


def test_windows_at_every_word_give_the_same():
    """Every window against every wording: ranks and winners do not depend on where windows begin."""
    scanner, draw = licenses.Scanner(), random.Random(3)
    for _ in range(25):
        picked = draw.sample(licenses.WORDINGS, 3)
        noisy = []
        for name, _, wording in picked:
            words = wording.split()
            if len(words) > 14:  # a few words of a long wording differ
                words[len(words) // 2 : len(words) // 2 + 1] = ["otherwise"]
            noisy.append(" ".join(words))
        text = " ".join(w for notice in noisy for w in (notice, sentence(draw)))
        assert scanner.matches(text) == scanner.matches(text, step=1)


def test_compression_decides(monkeypatch):
    """Without savings there are no candidates, and another dictionary changes the ranking."""
    text = licenses.WORDINGS[2][2]
    words, _ = licenses.words_at(text)
    names = [licenses.WORDINGS[c[2]][0] for c in licenses.Scanner().ranked(words)]
    assert names[0] == "MIT"
    swapped = tuple((n, d, licenses.WORDINGS[5][2] if k == 2 else w) for k, (n, d, w) in enumerate(licenses.WORDINGS))
    assert licenses.Scanner(swapped).ranked(words) != licenses.Scanner().ranked(words)
    monkeypatch.setattr(licenses.Scanner, "ranked", lambda self, words, step=None: [])
    assert licenses.Scanner().matches(text) == []
