import pytest
from pyspark.sql import functions as F

from lodestone.llm import scans

PROSE = (
    "Расход карбоната натрия составил десять единиц. Применение флотации снижает потери металла. Режим поддерживали на прежнем уровне. "
    "Содержание железа в растворе остаётся постоянным. Скорость перемешивания и качество продукта связаны между собой. "
)


def _blocks(spark, pages=6, extra=()):
    rows, n = [], 0
    for f in ("a.pdf", "b.pdf", "c.pdf", "d.docx"):
        for p in range(1, pages + 1):
            head = [] if f == "d.docx" else ["Вестник химии, том 9" if p % 2 else "Глава 2. Опыты"]
            tail = [] if f == "d.docx" else [f"- {p} -"]
            for text in [*head, PROSE, *tail]:
                rows.append((n, f, text, "text", p))
                n += 1
    rows.extend((n + k, *x) for k, x in enumerate(extra))
    df = spark.createDataFrame(rows, "id bigint, file string, content string, kind string, unit int")
    return scans.rows_of(df, "parsed_blocks", "id", "file", "content", df.kind, df.unit)


def _noise(spark, extra):
    b = _blocks(spark, extra=extra)
    got = scans.noise(b, scans.Learned(b)).collect()
    first = 4 * 6 + 3 * 6 * 2
    return {(int(r.row_key) - first, r.noise) for r in got if int(r.row_key) >= first}, got


def test_kinds(spark):
    extra = [
        ("a.pdf", "Расход карб0ната натрия и ре>ким", "text", 2), ("a.pdf", "Применение фло-\nтации снижает потери", "text", 2), ("a.pdf", "Вестник химии, том 9\nпотери металла.", "text", 3),
        ("b.pdf", "(4)", "text", 4), ("b.pdf", "тепло- и массообмен; тепло-\nи массообмен; тепло- и свет", "text", 4), ("a.pdf", "Глава 2. 0пыты   5", "text", 5),
        ("a.pdf", "Скорость переме-", "text", 5), ("d.docx", "Расход карб0ната", "text", 1), ("a.pdf", None, "text", 1), ("a.pdf", "  ", "text", 1), ("c.pdf", "Текст.\n- 3 -", "text", 3),
    ]
    got, every = _noise(spark, extra)
    assert got == {(0, "misread"), (1, "broken_word"), (2, "header"), (5, "header"), (5, "page_no"), (5, "misread"), (6, "broken_word"), (10, "page_no")}
    assert sum(r.noise == "page_no" for r in every) == 3 * 6 + 2


def test_paragraphs(spark):
    b = _blocks(spark, extra=[("a.pdf", "Вестник химии, том 9\n\nРасход карб0ната нат-\nрия составил\nдесять единиц.\n- 3 -", "text", 3)])
    text = {int(r.row_key): r.text for r in scans.paragraphs(b, scans.Learned(b)).collect()}
    assert text[60] == "Расход карбоната натрия составил десять единиц."


@pytest.mark.parametrize("size", [1, 1000])
def test_paragraphs_join_words_over_rows_and_empty_lines(spark, monkeypatch, size):
    monkeypatch.setattr(scans, "RANGE", size)
    rows = [
        ("Доля твёрдого оставалась в преде-", 0), ("- 3 -", 0), ("лах, 30 г/л. Расход нат-\n\n- 3 -\n\nрия со-", 0), ("ставил кар-", 0), ("б0ната. Конец-", 0), ("Начало тепло-", 0), ("и массообмен", 0),
        ("общая доля оста-", 0), ("доля оста-\nлась в покое", 10),
    ]
    extra = [("b.pdf", "тепло- и свет, тепло- и свет; карб0ната", "text", 1)] + [("a.pdf", t, "text", 3) for t, _ in rows]
    b = _blocks(spark, extra=extra)
    first = 4 * 6 + 3 * 6 * 2 + 1
    k = F.col("row_key").cast("int")
    overlap = F.coalesce(*[F.when(k == first + i, n) for i, (_, n) in enumerate(rows)], F.lit(0))
    got = scans.paragraphs(b.withColumn("place", k.cast("long")).withColumn("overlap", overlap), scans.Learned(b)).collect()
    text = {int(r.row_key) - first: r.text for r in got}
    assert [text[i] for i in range(len(rows))] == [
        "Доля твёрдого оставалась в пределах,", "", "30 г/л. Расход натрия составил", "карбоната.", "Конец-", "Начало тепло-", "и массообмен",
        "общая доля осталась", "доля осталась в покое",
    ]
    assert len(got) == len({r.row_key for r in got})


def test_repeated_rows_and_the_way_beyond_the_broadcast(spark, monkeypatch):
    extra = [("a.pdf", "Расход карб0ната", "text", 2)] * 2
    wide, _ = _noise(spark, extra)
    monkeypatch.setattr(scans, "BROADCAST", 0)
    assert _noise(spark, extra)[0] == wide == {(0, "misread"), (1, "misread")}


def test_glyph_edits_and_skeletons(spark):
    pairs = [("ре>ким", "режим", 1), ("рафипиро8ания", "рафинирования", 2), ("промьiщленным", "промышленным", 2), ("помощь10", "помощью", 1), ("fumace", "furnace", 1), ("rnoclem", "modern", 3), ("металл", "металл", 0)]
    df = spark.createDataFrame(pairs, "word string, near string, n int").where(scans.shape_key(F.col("word")) == scans.shape_key(F.col("near")))
    assert {tuple(r) for r in df.collect()} == {p for p in pairs} and all(scans.misread_glyphs(w, x) == n for w, x, n in pairs)
    assert scans.misread_glyphs("режим", "ре>ким") is None and scans.misread_glyphs("том", "дом") is None
    long = "в" * 300
    assert scans.misread_glyphs(long.replace("в", "8"), long) == 300
    assert scans.skeleton("Гла8а 1. Схема цепи алпаратов") == scans.skeleton("Глава 1. Схема цепи аппаратов")
    assert scans.page_style("xiv") == ("roman", 14) and scans.page_style("Page 4 of 9") == ("of", 4) and scans.page_style("Рис. 4") is None
    assert scans.page_style("(" + " " * 40 + "4)") is None and scans.page_style("стр." + " " * 40 + "4") == ("word", 4)
    assert scans.before("а" * 500, 500) == "а" * 500 and scans.before("x " + "б" * 60, 62) == "б" * 60


def test_long_titles_repeat_over_pages(spark):
    title = "Сборник трудов отраслевого совещания по вопросам переработки упорных руд и концентратов цветных металлов, выпуск второй"
    b = _blocks(spark, extra=[("a.pdf", title, "text", p) for p in range(1, 7)])
    assert len(title) > 90 and sum(r.noise == "header" for r in scans.noise(b, scans.Learned(b)).collect()) == 3 * 6 + 6


def test_corrections_follow_the_context():
    around = {w: {scans.bucket(x): 2.0 for x in c} for w, c in {"тонна": ("одна", "руды"), "гонна": ("полная", "ткани")}.items()}
    fixes = {"т0нна": [(w, 1.0, v) for w, v in around.items()], "c": [("e", 1.0, None)]}
    assert scans.corrected("Одна т0нна руды; полная Т0нна ткани. Вчера была т0нна", fixes) == "Одна тонна руды; полная Гонна ткани. Вчера была тонна"


def test_skip_grams_against_counts(spark):
    texts = ["красная руда лежит рядом", "красная глина лежит рядом", "синяя вода течёт быстро", "красная руда лежит тихо"]
    held = scans.Contexts()
    held.add([t.split() for t in texts[:2]])
    held.add([t.split() for t in texts[2:]])
    taken = {w: (n, dict(zip(b, c, strict=True))) for w, n, b, c in held.taken()}
    assert taken["руда"] == (2, {scans.bucket("красная"): 2, scans.bucket("лежит"): 2, scans.bucket("рядом"): 1, scans.bucket("тихо"): 1}) and not held.ids
    rows = [(w, b, c) for w, (_, own) in taken.items() for b, c in own.items()]
    contexts = spark.createDataFrame(rows, "word string, bucket int, n long")
    v = {r.word: r.vector for r in scans.skip_grams(contexts, spark.createDataFrame([("руда",), ("глина",), ("вода",), ("нет",)], "word string")).collect()}
    cos = lambda a, b: sum(x * b.get(k, 0) for k, x in a.items())
    assert set(v) == {"руда", "глина", "вода"} and cos(v["руда"], v["глина"]) > cos(v["руда"], v["вода"]) == 0
