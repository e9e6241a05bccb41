"""Word lattices: segmentation, and gaps judged by words that the test tables don't hold."""

import pytest

from sievework.llm import lattice
from sievework.llm.sentences import sentences


def test_segments_cover_the_text_and_find_words():
    for text, words in (
        ("これは図書館です", ["これ", "です"]), ("报告为什么不要", ["为什么", "不要"]), ("電車が来ました", ["が"]), ("ブレーキを修理する", ["ブレーキ", "を"]), ("我们现在出发", ["我们", "现在"]), ("ใครมาแล้ว", ["ใคร", "แล้ว"]),
    ):
        got = lattice.segment(text)
        assert "".join(got) == text and all(w in got for w in words), got
    assert lattice.segment("") == []
    assert "".join(lattice.segment("漢" * 50_000)) == "漢" * 50_000


@pytest.mark.parametrize(
    "text, n",
    [
        # endings close, connective forms run on
        ("雨が降り出した…傘を買う。", 2), ("彼は黙っていて…窓を見た。", 1), ("部屋が暗くて……何も見えない。", 1), ("もう帰ります…お疲れさまでした。", 2), ("とても寒い…早く春が来てほしい。", 2), ("駅まで歩いて……電車に乗った。", 1),
        # an opening word after a noun
        ("長い沈黙…しかし誰も動かない。", 2), ("最後の手紙…この人は誰だろう。", 2),
        # Chinese: the last noun's character doesn't matter
        ("最后一次…天黑了。", 2), ("最后一天…天黑了。", 2), ("这是问题…天黑了。", 2), ("这是规定…天黑了。", 2), ("他走了……我们再等一会儿。", 2),
        # a begun clause, a word said again, a connective
        ("但是……没有人回答。", 1), ("我……我不知道。", 1), ("他很累……但没有停下。", 1),
        # line breaks: an ending and an opening, or no end
        ("荷物を運んだ\nしかし誰もいない。", 2), ("荷物を\n運んだ。", 1), ("火车开走了\n我们回家吧。", 2), ("火车\n开走了。", 1),
        # quotations
        ("彼女は「もう遅い。」と言った。", 1), ("「もう遅い。」彼女は言った。", 2),
        # Thai
        ("เขากลับบ้านแล้ว พรุ่งนี้จะมาใหม่", 2),
    ],
)
def test_gaps_of_spaceless_scripts(text, n):
    assert len(sentences(text)) == n, [text[a:b] for a, b in sentences(text)]


def test_long_words_and_spaces_are_read_whole():
    # an abbreviation after any white space, an ordinal far from its article
    assert len(sentences("Das gilt z." + " " * 40 + "B. hier. Es endet.")) == 2
    assert len(sentences("Es war der" + " " * 60 + "3. Versuch von allen. Ende.")) == 2
    assert len(sentences("ก" * 300 + "a b" + "ก" * 300)) == 2


def test_no_noun_characters_among_particles():
    assert not set("入次题突锁记") & lattice.ZH_FINAL
