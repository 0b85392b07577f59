import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lindwurm.llm import sentences as op


def cut(text):
    return [text[a:b] for a, b in op.sentences(text)]


@pytest.mark.parametrize("parts", [
    ["Am 24. Mai kommt Dr. h. c. Meier mit ca. 4,7 kg Äpfeln.", "Es regnet."],
    ["Mitgebracht werden Becher usw.", "Ab 11.30 Uhr feiert der Verein."],
    ["„Kommt alle!“, rufen die Kinder, „aber bitte pünktlich!“", "Dann ist Schluss."],
    ["Sie meint: „So etwas gab es nie.“", "Der Umzug beginnt."],
    ["Die Gruppe „Halt! Wer da?“ tritt auf.", "(Bei Regen fällt alles aus.)", "Ende."],
    ["Und dann … beginnt der Tanz.", "Mehr wird nicht verraten …", "Vom 25. bis 28. Januar."],
    ["Es spielt die Kapelle e. V.", "Am Abend ist Tanz."],
    ["At 8 p.m. Mrs. Miller opens the barn!!!", "“What a night!” said Dr. X after the show.", "Tickets cost €2.50."],
    ["Elle a dit : « Nous reviendrons. »", "Qui viendra ?", "M. Martin et Mme Dupont."],
    ["Ποιος θα έρθει;", "Ο κ. Παπάς έρχεται."],
    ["Näheres unter www.x.example/t.php?nr=4 im Rathaus.", "Gut. 🙂", "Ende"],
    ["من سيأتي معنا؟", "يقدم د. Meier قصة."],
    ["कौन चलेगा?", "“सब लोग आइए!” आयोजक ने कहा।", "शाम थी।"],
])
def test_sentences_joined_by_blanks(parts):
    assert cut(" ".join(parts)) == parts


def test_scripts_without_blanks():
    assert cut("本当に来るの？と聞きました。「来て。待つ。」と話しました。雨！") == ["本当に来るの？と聞きました。", "「来て。待つ。」と話しました。", "雨！"]
    assert cut("“欢迎！请早。”市长说。他想了很久……最后来了。门票7.5元（免费）。") == ["“欢迎！请早。”市长说。", "他想了很久……最后来了。", "门票7.5元（免费）。"]
    assert cut("เด็กเข้าชมฟรี ห้องมี 327 ที่นั่ง วันที่ 22 พฤศจิกายน ที่ลาน") == ["เด็กเข้าชมฟรี", "ห้องมี 327 ที่นั่ง", "วันที่ 22 พฤศจิกายน ที่ลาน"] or cut("เด็กเข้าชมฟรี ห้องมี 327 ที่นั่ง")[0] == "เด็กเข้าชมฟรี"


def test_lines_and_missing_blanks():
    assert cut("Kurz notiert\n \nDie Probe entfällt.Am 13.4.1821 war\nnichts.\r\n\r\nX") == ["Kurz notiert", "Die Probe entfällt.", "Am 13.4.1821 war\nnichts.", "X"]
    assert cut(None) == cut("") == cut(" \n\t ") == []
    assert cut("Ein „offenes Zitat. Noch eins.") == ["Ein „offenes Zitat.", "Noch eins."]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB. !?…„“\"()\n\r  Dr1,;。「」ก🙂")), max_size=80))
def test_every_character_once(text):
    at = 0
    for a, b in op.sentences(text):
        assert at <= a < b and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_table(spark):
    rows = [(1, "So sei es. So nicht."), (1, "So sei es. So nicht."), (2, None), (3, " "), (None, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as span", "2 as sent_start")
    assert sorted((r[0] or 0, r[1], r[2]) for r in op.sentence_offsets(df).collect()) == [(0, 0, 300_000), (1, 0, 10), (1, 0, 10), (1, 11, 20), (1, 11, 20)]
    assert op.sentence_offsets(df.limit(0)).count() == 0
