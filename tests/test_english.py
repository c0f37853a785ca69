"""Stems, stop words and ranks of English text search against known values."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import english as X

KNOWN = """consign consign consigned consign consistency consist consistent consist consisting consist consolation consol consolations consol consolatory consolatori consoled consol
consolingly consol conspicuously conspicu conspiracy conspiraci conspirators conspir constable constabl constancy constanc constant constant knack knack knackeries knackeri knaves knave
knavish knavish kneaded knead kneel kneel knees knee knightly knight knitting knit knives knive knobs knob knock knock knotted knot known known knows know generously generous general general
communities communiti community communiti skies sky dying die happy happi hopping hop hoping hope falling fall filing file relational relat national nation universities univers programming program
programs program computing comput computers comput sciences scienc introduction introduct studies studi ties tie cries cri by by say say enjoy enjoy boys boy gas gas this this kiwis kiwi
agreed agre feed feed proceeding proceed luxuriated luxuri hopefulness hope activities activ electrical electr organization organ probably probabl analogy analog fluently fluentli beautifully beauti
inning inning news news exceedingly exceed rolling roll controlled control replacement replac adjustment adjust adoption adopt effective effect rate rate cease ceas bee bee youth youth yes yes
o'neil's o'neil triplicate triplic formalize formal argued argu physics physic calculus calculus mathematics mathemat engineering engin algebra algebra statistics statist history histori""".split()


@pytest.mark.parametrize("word,want", list(zip(KNOWN[::2], KNOWN[1::2])))
def test_stems(word, want):
    assert X.stem(word) == want


def test_lexemes_and_ranks(spark):
    rows = [("The Small Widgets", "small widget"), ("small and very small widgets", "widgets, small"), ("widgets", "the widget"), ("Widgets of widgets", "widget"), (None, None), ("of the", "a")]
    got = spark.createDataFrame(rows, "t string, q string").select(X.lexemes(F.col("t")).alias("held"), X.asked(F.col("q")).alias("want"))
    out = got.select("held", "want", X.match_rank(F.col("held"), F.col("want")).alias("rank")).collect()
    assert out[0]["held"] == ["", "small", "widget"] and out[0]["want"] == ["small", "widget"] and out[0]["rank"] == 0.099103
    far = 0.1 / (1.005 + 0.05 * 2.718281828 ** (4 / 1.5 - 2)) ** 0.5
    assert out[1]["rank"] == pytest.approx(1 - (1 - 0.099103) * (1 - far), abs=2e-6)
    assert out[2]["rank"] == 0.060793 and out[3]["rank"] == pytest.approx(0.060793 * 1.25, abs=2e-6)
    assert out[4]["held"] == [] and out[5]["want"] == []
