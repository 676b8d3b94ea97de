import pytest
from pyspark.sql import functions as F

from lodestone.llm import truncation

CORPUS = [
    "Испытания выполнены на площадке фабрики в условиях, приближенных к промышленным.", "Расход реагента составил 5,3 кг/т при прочих равных условиях.",
    "На площадке фабрики выполнены новые испытания, условия прежние.\nПротокол № 7 утверждён", "Результат устойчив.\nПротокол № 12 утверждён",
    "Текст готов.\n## Выводы", "## Выводы\nДальше идёт текст.", "Всё готово.\nКлючевые слова: флотация, реагент", "Опыт дал реагент и флотация прошла.", "Итог.\n| Итого | 9,9 |",
]


def _cut(spark, texts):
    rows = [(k, t, "s", 1) for k, t in enumerate([*CORPUS * 3, *texts])]
    df = spark.createDataFrame(rows, "id bigint, t string, source string, doc_id int")
    got = {r.doc_id: r.truncated for r in truncation.verdicts(df, "id", "t").collect()}
    return [got.get(k) for k in range(len(CORPUS) * 3, len(rows))], got


def test_cut_texts(spark):
    cut = [
        "Испытания выполнены на площадке фаб", "Испытания выполнены на площадке", "Расход реагента составил 5,", "Расход реагента (см.", "Расход реагента составил…",
        "Расход реаг�", "Готово.\n| Итого | 9", "Испытания «на площадке", "Всё готово.\nКлючевые слова: флотация, реаг", "Расход реагента [...]",
    ]
    assert _cut(spark, cut)[0] == [True] * len(cut)


def test_complete_texts(spark):
    whole = [*CORPUS, "Готово (см. раздел 5).", "Готово.\n(конец)", "Готово.\n- реагент", "Готово!"]
    verdicts, every = _cut(spark, whole)
    assert verdicts == [False] * len(whole)


def test_nulls_blanks_repeats_and_empty(spark):
    assert _cut(spark, [None, "", "  \n", "Расход реагента состав", "Расход реагента состав"])[0] == [None, None, None, True, True]
    df = spark.createDataFrame([], "id bigint, t string, source string")
    assert truncation.verdicts(df, "id", "t").count() == 0 and truncation.truncation_rates(df, "id", "t", "source").count() == 0


def test_breaks_inside_openers_of_earlier_lines(spark):
    cut = [
        "Режим (первая ступень не закрыта.\nРасход реагента прежний.", "<b>Режим без изменений.\nРасход реагента прежний.", 'Мастер сказал: "режим прежний.\nРасход реагента прежний.',
        "Режим «на площадке.\nРасход реагента прежний", "Расход реагента составил \\u04", "Расход реагента составил &nb", "Режим <i>на площадке",
    ]
    whole = [
        'Мастер сказал: "режим (прежний)".\nРасход реагента прежний.', "<p>Режим <b>прежний</b>.<br>\nРасход реагента прежний.", 'Труба 5" и 3" готова.\nРасход реагента прежний.',
        "а) режим; б) расход.", "При x<y и z>w режим прежний.", 'Знак \\" в строке. Режим прежний.',
    ]
    usual = [f"Опыт {k} завершён." for k in range(80)]
    assert _cut(spark, [*cut, *whole, *usual])[0] == [True] * len(cut) + [False] * (len(whole) + len(usual))


def test_baseline_of_the_source(spark):
    long = "Отделение приняло партию сырья и провело полную серию измерений по утверждённой методике контроля качества"
    rows = [("strict", f"{long} {k}.\n" * 3 + "Конец.") for k in range(20)] + [("loose", f"{long} {k}\n" * 3 + "Конец.") for k in range(20)]
    rows += [(s, f"Вводная часть готова.\nНикогда прежде здесь не встречались такие необычные {w} и прочие невиданные доселе удивительнейшие {w}ы") for s, w in (("strict", "квазары"), ("loose", "пульсары"))]
    rows += [("open", f"Вариант ({k} готов.") for k in range(20)] + [("strict", "Вариант (7 готов.")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id bigint, source string, t string")
    got = {r.doc_id: r.truncated for r in truncation.verdicts(df, "id", "t", "source").collect()}
    assert sorted(k for k, t in got.items() if t) == [40, 62] and got[40] and not got[41] and got[62] and not got[45]


def test_copies_have_one_vote(spark):
    texts = ["Испытания выполнены на площадке фабрики в цехе.", "Смена провела опыт на площадке фабрики ночью.", *["Испытания выполнены на площадке фаб"] * 30]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id bigint, t string")
    got = {r.doc_id: r.truncated for r in truncation.verdicts(df, "id", "t").collect()}
    assert [got[k] for k in range(len(texts))] == [False] * 2 + [True] * 30


def test_long_words_are_not_taken_apart_everywhere(spark):
    df = spark.createDataFrame([(0, "Код " + "ab" * 300_000 + " принят."), (1, "Код " + "ab" * 20)], "id bigint, t string")
    assert {r.doc_id: r.truncated for r in truncation.verdicts(df, "id", "t").collect()} == {0: False, 1: True}


@pytest.mark.parametrize(
    ("text", "left"),
    [("(a [b] c", "("), ("«a» (b)", ""), ("a) b", ""), ("{[(", "{[("), ("(]", "("), ("([)", ""), ('"a (b" c', ""), ("<b><i>a</b>", ""), ("<B x='1'>a", "<b"), ('5" a', ""), ('"5"', "")],
)
def test_stack(spark, text, left):
    assert spark.range(1).select(truncation.open_brackets(F.lit(text)).alias("x")).first().x == left


def test_rates(spark):
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate([*CORPUS, "Расход реагента (см."])], "id bigint, t string, source string, doc_id int")
    r = truncation.truncation_rates(df, "id", "t", "source").first()
    assert (r.n_texts, r.n_truncated, r.rate, r.usual_cut_length) == (10, 1, 0.1, 20)
    whole = truncation.truncation_rates(df.where("id < 9"), "id", "t", "source").first()
    assert (whole.n_truncated, whole.usual_cut_length, whole.n_at_that_length) == (0, None, 0)
