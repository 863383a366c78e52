"""Stems against a published word list, and full-text search."""

from logloom.functions.english import STOP_WORDS, common_start, lexemes, stem
from logloom.operators import search

#: Words and stems of the algorithm's published sample vocabulary.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead
knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit
knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot"""
MORE = """running run runs run run run studies studi study studi studying studi generate generat generously generous generic generic communities communiti ties tie cries cri gas gas this this gaps gap kiwis kiwi luxuriated luxuri hopping hop hoped hope hoping hope
bed bed sing sing by by say say cry cri relational relat conditional condit rationalization ration sensational sensat valenci valenc digitizer digit vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formality formal sensitivity sensit sensibility sensibl analogies analog triplicate triplic formative format formalize formal electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control rolling roll
skis ski dying die news news proceed proceed proceeds proceed succeed succeed inning inning skies sky youth youth boy boy boyish boyish happily happili agreed agre feed feed plastered plaster motoring motor caresses caress ponies poni"""


def pairs(text):
    words = text.split()
    return list(zip(words[::2], words[1::2], strict=True))


def test_published_sample():
    assert [(w, stem(w)) for w, _ in pairs(SAMPLE)] == pairs(SAMPLE)


def test_more_words():
    assert [(w, stem(w)) for w, _ in pairs(MORE)] == pairs(MORE)


def test_every_word_begins_as_its_stem_says():
    assert all(w.startswith(common_start(stem(w))) for w, _ in pairs(SAMPLE) + pairs(MORE))


def test_lexemes():
    assert lexemes("The runner's RUNNING; it's John’s study, isn't it? x-1") == {"runner", "run", "john", "studi", "isn", "x", "1"}
    assert lexemes(None) == lexemes("the of") == set() and len(STOP_WORDS) == 127


def test_search_by_words(spark):
    rows = [(1, "running quickly, studies"), (2, "He ran"), (3, "runs a study"), (4, None), (5, "RUNNER"), (6, "overrun")]
    logs = spark.createDataFrame(rows, "id int, message string")
    found = lambda q: sorted(r["id"] for r in search.search(logs, text=q, mode="words").collect())
    assert found("run") == [1, 3] and found("the studying") == [1, 3] and found("run quick") == [1] and found("runners") == [5] and found("the of") == []
