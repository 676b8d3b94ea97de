"""Analysis of questions and the choice of an answer source, as columns over a table of questions.

Java patterns carry (?iuU) so that case and word borders work for Cyrillic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cues of questions. Each list is a set of alternatives of one marker.
QUESTION = "какие|какой|какая|каким|как|где|когда|сколько|почему|зачем|чем|кто|что|куда|откуда|можно|есть ли|существует ли|which|what|how|where|when|why|who|whom|whose"
GEO = (
    "россия|рф|зарубежом|за рубежом|мировая практика|отечественная практика|снг|евросоюз|китай|индия|африка|канада|сша|норвегия|финляндия|"
    "норникель|норильск|кольский|таймыр|печенега|никельский|russia|usa|china|eu|europe|asia|africa|canada|norway|finland|worldwide"
)
TEMPORAL = r"за последние|последние|в\s+\d{4}|в\s+прошлом|с\s+\d{4}|по\s+\d{4}|с\s+начала|годы|года|лет|год|last|recent|since|until|by\s+\d{4}|in\s+\d{4}|over\s+the\s+past"
DEFINITIONAL = (
    r"что такое|что значит|что означает|что представляет|определение\s|определи\s|расшифруй|расшифровка|аббревиатура|аббревиатурой|"
    "what is|what does|define|definition of|stands for|meaning of"
)
CAUSAL = (
    r"почему|зачем|как\s+работает|за\s+сч[её]т|благодаря\s+чему|в\s+результате\s+чего|объясни\s|каким\s+образом\s|"
    "why|how does|how is|how do|reason for|because of|due to|mechanism behind|explanation"
)
COMPARISON = (
    r"сравни\s|сравните\s|сравнение\s|по\s+сравнению\s+с\s|разница\s+между\s|отличие\s+от\s|vs|versus|or alternatively|compared to|"
    "comparison of|differences between|distinguish"
)
GEO_COMPARISON = (
    r"отечественн[а-яё]*\s+практик[а-яё]*|зарубежн[а-яё]*\s+практик[а-яё]*|миров[а-яё]*\s+практик[а-яё]*|"
    r"(?:росси|рф)\s*(?:vs|и|или|против|versus)\s*(?:зарубеж|миров|запад)|(?:domestic|russian)\s+(?:vs|versus|or)\s+(?:world|abroad|foreign)|worldwide\s+practice"
)
UNITS = "мг/л|мг/дм3|г/л|м3/ч|м3/сут|т/сут|кг/ч|квт|мвт|мм/сут|а/м2|а/дм3|ма/см2|%|°c|атм|мпа|па|об%|ppm|°"
WORD = "[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9-]+"
# Domain stems with their labels; the first stem that begins a word decides.
STEMS = (
    ("никел", "никель"), ("мед", "медь"), ("кобал", "кобальт"), ("золот", "золото"), ("серебр", "серебро"), ("мпг", "МПГ"), ("штейн", "штейн"),
    ("шлак", "шлак"), ("катод", "катод"), ("анод", "анод"), ("электролит", "электролит"), ("католит", "католит"), ("анолит", "анолит"),
    ("шихт", "шихта"), ("руд", "руда"), ("концентр", "концентрат"), ("хвост", "хвосты"), ("печ", "печь"), ("ванн", "ванна"),
    ("флотомашин", "флотомашина"), ("выщелачив", "выщелачивание"), ("флотац", "флотация"), ("электроэкстракц", "электроэкстракция"),
    ("электролиз", "электролиз"), ("очистк", "очистка"), ("обессерив", "обессеривание"), ("обессолив", "обессоливание"), ("осажден", "осаждение"),
    ("пвп", "ПВП"), ("автоклав", "автоклав"), ("гидрометаллург", "гидрометаллургия"), ("пирометаллург", "пирометаллургия"), ("катодн", "катодный"),
    ("техногенн", "техногенный"), ("гипс", "гипс"), ("шахтн", "шахтная"), ("вод", "вода"), ("закач", "закачка"), ("горизонт", "горизонт"),
    ("тэп", "ТЭП"), ("рудничн", "рудничная"), ("сульфат", "сульфат"), ("хлорид", "хлорид"), ("пропитк", "пропитка"), ("кек", "кек"), ("сер", "сера"),
    ("so2", "SO2"), ("материал", "материал"), ("оборудован", "оборудование"), ("эксперимент", "эксперимент"), ("процесс", "процесс"),
)
_LETTER = "[A-Za-zА-Яа-яЁё0-9_]"


def bounded(alternatives: str) -> str:
    """Pattern for alternatives that stand between other characters than letters, digits and underscores.

    It is written without look-around, so that other engines read it too.
    """
    return rf"(?i)(^|[^A-Za-zА-Яа-яЁё0-9_])({alternatives})($|[^A-Za-zА-Яа-яЁё0-9_])"


def has(text: Column, alternatives: str) -> Column:
    """Whether a marker occurs; texts are compared in lower case."""
    return F.concat(F.lower(text), F.lit(" ")).rlike(bounded(alternatives))


def analyzed(questions: DataFrame, text: str) -> DataFrame:
    """Adds the markers, counts and the numeric constraint of each question."""
    q = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(q)
    num = r"([0-9]+(?:[.,][0-9]+)?)"
    value = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    rng = rf"(?:от|from|между|between) +{num} *(?:до|to|-) *{num} *({UNITS})?"
    ph = rf"ph *([<>≤≥]=?) *{num}"
    op = rf"(≤|<=|≥|>=|<|>) *{num} *({UNITS})?"
    bare = rf"(?:^|[^0-9a-zа-яё.,]){num} *({UNITS})"
    sign = lambda c: F.when(c.isin("≤", "<=", "≤="), "<=").when(c.isin("≥", ">=", "≥="), ">=").otherwise(c)
    part = lambda p, k: F.nullif(F.regexp_extract(low, p, k), F.lit(""))
    kind = F.when(low.rlike(rng), "range").when(low.rlike(ph), "unit_first").when(low.rlike(op), "operator").when(low.rlike(bare), "bare")
    single = F.when(F.col("numeric_kind") == "unit_first", value(part(ph, 2))).when(F.col("numeric_kind") == "operator", value(part(op, 2)))
    sgn = F.when(F.col("numeric_kind") == "unit_first", sign(part(ph, 1))).when(F.col("numeric_kind") == "operator", sign(part(op, 1)))
    out = questions.withColumn("numeric_kind", kind)
    out = out.withColumn("numeric_operator", F.when(F.col("numeric_kind") == "range", "range").when(F.col("numeric_kind") == "bare", "=").otherwise(sgn))
    upper, lower = F.col("numeric_operator").isin("<=", "<"), F.col("numeric_operator").isin(">=", ">")
    lo = F.when(F.col("numeric_kind") == "range", value(part(rng, 1))).when(F.col("numeric_kind") == "bare", value(part(bare, 1))).when(lower, single)
    hi = F.when(F.col("numeric_kind") == "range", value(part(rng, 2))).when(F.col("numeric_kind") == "bare", value(part(bare, 1))).when(upper, single)
    unit = (
        F.when(F.col("numeric_kind") == "range", part(rng, 3)).when(F.col("numeric_kind") == "unit_first", "pH")
        .when(F.col("numeric_kind") == "operator", part(op, 3)).when(F.col("numeric_kind") == "bare", part(bare, 2))
    )
    marks = {
        "is_question": q.contains("?") | has(q, QUESTION), "has_geo": has(q, GEO) | has(q, GEO_COMPARISON), "has_temporal": has(q, TEMPORAL),
        "is_definitional": has(q, DEFINITIONAL), "is_causal": has(q, CAUSAL), "is_comparison": has(q, COMPARISON),
        "is_geo_comparison": has(q, GEO_COMPARISON), "has_numeric": F.col("numeric_kind").isNotNull(),
        "token_count": F.size(F.regexp_extract_all(q, F.lit(WORD), F.lit(0))), "numeric_min": lo, "numeric_max": hi, "numeric_unit": unit,
    }
    return out.withColumns(marks)


def stem_table(spark) -> DataFrame:
    """(stem, label, place) of the domain vocabulary; fixed size."""
    return spark.createDataFrame([(s, label, i) for i, (s, label) in enumerate(STEMS)], "stem string, label string, place int")


def seeds(questions: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, canonical, confidence): domain words by stem (.6) and words in capitals (.55); each name once at its best.

    A word meets a stem through its prefixes, so the join is by equality.
    """
    words = questions.select(F.col(query_id).alias("query_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("word"))
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(16))), lambda n: F.substring(F.lower("word"), F.lit(1), n)))
    stems = stem_table(questions.sparkSession)
    domain = words.select("query_id", "word", prefix.alias("stem")).join(F.broadcast(stems), "stem")
    domain = domain.groupBy("query_id", "word").agg(F.min_by("label", "place").alias("canonical"))
    capital = words.where(F.col("word").rlike(r"^[A-ZА-ЯЁ]")).select("query_id", F.col("word").alias("canonical"))
    every = domain.select("query_id", "canonical", F.lit(0.6).alias("confidence")).unionByName(capital.withColumn("confidence", F.lit(0.55)))
    return every.groupBy("query_id", F.lower("canonical").alias("canonical")).agg(F.max("confidence").alias("confidence"))


@dataclass(frozen=True)
class RouteWeights:
    """Weights of the coverage score (they sum to 1) and the thresholds of the decision."""

    seed: float = 0.40
    hops: float = 0.20
    density: float = 0.20
    sources: float = 0.10
    confidence: float = 0.10
    graph_coverage: float = 0.62
    graph_confidence: float = 0.55
    graph_ambiguity: float = 0.70


def scores(q: DataFrame, w: RouteWeights | None = None) -> DataFrame:
    """Adds coverage, confidence and ambiguity scores from n_seeds, seed_ratio, max_hop, n_nodes, n_edges, n_sources,
    mean_confidence, n_contradictions and n_gaps."""
    w = w or RouteWeights()
    hops = F.when(F.col("max_hop") <= 0, 0.0).when(F.col("max_hop") == 1, 0.35).when(F.col("max_hop") == 2, 0.7).otherwise(1.0)
    density = F.least(F.lit(1.0), F.log1p(F.col("n_edges") / F.greatest(F.col("n_nodes"), F.lit(1))) / F.log1p(F.lit(4.0)))
    sources = F.least(F.lit(1.0), F.log1p("n_sources") / F.log1p(F.lit(5.0)))
    clash = F.col("n_contradictions") > 0
    cover = w.seed * F.col("seed_ratio") + w.hops * hops + w.density * density + w.sources * sources + w.confidence * F.col("mean_confidence")
    cover = F.greatest(F.lit(0.0), cover - F.when(clash, 0.10).otherwise(0.0))
    conf = 0.65 * F.col("mean_confidence") + 0.35 / (1 + F.col("n_gaps"))
    conf = F.greatest(F.lit(0.0), conf - F.when(clash, 0.05).otherwise(0.0))
    n = F.col("token_count")
    words = F.when(n <= 1, 1.0).when(n <= 3, 0.7).when(n <= 6, 0.4).otherwise(0.2)
    s = F.col("n_seeds")
    named = F.when(s == 0, 0.8).when(s == 1, 0.2).when(s <= 3, 0.4).otherwise(0.7)
    clear = F.when((F.col("n_edges") >= 5) & (F.col("seed_ratio") >= 0.6), 0.7).when(F.col("n_edges") > 0, 0.4).otherwise(0.0)
    vague = 0.45 * words + 0.35 * named + 0.20 * (1 - clear)
    return q.withColumns({"coverage_score": F.round(cover, 10), "confidence_score": F.round(conf, 10), "ambiguity_score": F.round(vague, 10)})


def decided(q: DataFrame, w: RouteWeights | None = None) -> DataFrame:
    """Adds route, route_confidence and rule; the first rule that holds decides."""
    w = w or RouteWeights()
    c = F.col
    rules = [
        (F.trim("question") == "", "no_data", 0.95, "empty_query"),
        (((c("token_count") < 3) | (c("n_seeds") == 0)) & ~c("has_numeric"), "no_data", 0.95, "low_signal_query"),
        (c("is_definitional") & (c("n_edges") < 2), "rag_only", 0.74, "definitional_query"),
        (c("is_geo_comparison") & (c("n_edges") > 0), "hybrid", 0.78, "geo_comparison_query"),
        (c("is_comparison") & (c("n_edges") > 0), "hybrid", 0.76, "comparison_query"),
        (c("is_causal") & (c("n_edges") >= 1), "hybrid", 0.75, "causal_query"),
        (c("has_numeric") & (c("n_edges") >= 3) & (c("coverage_score") >= w.graph_coverage - 0.1), "graph_only", 0.80, "numeric_filtered_graph_sufficient"),
        ((c("n_nodes") == 0) & (c("n_edges") == 0) & (c("n_seeds") > 0), "rag_only", 0.78, "seeds_not_in_graph"),
        ((c("n_nodes") == 0) & (c("n_edges") == 0), "no_data", 0.95, "graph_empty"),
        (c("n_edges") == 0, "rag_only", 0.72, "matched_nodes_without_relations"),
        (
            (c("coverage_score") >= w.graph_coverage) & (c("confidence_score") >= w.graph_confidence)
            & (c("ambiguity_score") <= w.graph_ambiguity) & (c("n_contradictions") == 0),
            "graph_only", 0.82, "graph_only_conditions_met",
        ),
        ((c("n_contradictions") > 0) | (c("coverage_score") < w.graph_coverage), "hybrid", 0.74, "partial_graph_coverage"),
    ]
    pick = lambda k, last: _chain([(r[0], r[k]) for r in rules], last)
    return q.withColumns({"route": pick(1, "rag_only"), "route_confidence": pick(2, 0.70), "rule": pick(3, "below_hybrid_floor")})


def _chain(pairs: list, last) -> Column:
    out = F.when(pairs[0][0], F.lit(pairs[0][1]))
    for test, value in pairs[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(last))


# Technical values and words of relations in a chunk.
TECHNICAL = r"[0-9]+(?:[,.][0-9]+)?\s*(?:%|°C|г/л|мг/л|м3/ч|А/м2|pH)"
RELATION_CUES = ("влияет", "повышает", "снижает", "использует", "получен", "проводили", "зависит", "подтвержден", "описан", "применяется", "заменяет")


def extraction_route(chunks: DataFrame) -> DataFrame:
    """Adds the extraction route of a chunk from its text, its statistical entities (n_ner, ner_chars) and earlier model
    entities (n_llm, llm_confidence)."""
    n = F.length("text")
    technical = F.regexp_count("text", F.lit("(?iu)" + TECHNICAL)) / F.greatest(n, F.lit(1))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    cues = F.size(F.filter(words, lambda w: w.isin(*RELATION_CUES)))
    c = F.col
    out = chunks.withColumns({"technical_density": F.round(technical, 6), "relation_cues": cues})
    dense = (c("technical_density") > 0.0015) | (c("relation_cues") >= 2)
    rules = [
        (F.trim("text") == "", ("skip", 1.0, "empty_chunk")),
        ((n <= 350) & (c("relation_cues") == 0), ("natasha_only", 0.76, "short_low_relation_signal")),
        (n >= 4500, ("ensemble", 0.82, "long_chunk_requires_llm_semantics")),
        (dense & (c("n_ner") > 0), ("ensemble", 0.84, "technical_or_relation_dense;natasha_seeds_available")),
        (dense, ("llm_only", 0.75, "technical_or_relation_dense")),
        ((c("n_llm") > 0) & (c("llm_confidence") < 0.55), ("ensemble", 0.78, "low_llm_confidence_requires_ensemble")),
        ((c("n_ner") > 0) & (c("ner_chars") / F.greatest(n, F.lit(1)) < 0.003), ("llm_only", 0.72, "sparse_natasha_coverage_requires_llm")),
        ((c("n_ner") > 0) & (c("relation_cues") == 0), ("natasha_only", 0.70, "entity_only_chunk")),
    ]
    last = ("ensemble", 0.68, "default_semantic_extraction")
    pick = lambda k: _chain([(t, v[k]) for t, v in rules], last[k])
    return out.withColumns({"route": pick(0), "route_confidence": pick(1), "reason": pick(2)})


def fallback_route(decided: DataFrame) -> DataFrame:
    """Adds the route to take after an extraction that gave n_entities and n_relations of mean ``result_confidence``, and its reason
    ('' where the first route stands)."""
    c = F.col
    rules = [
        (c("route") == "skip", (None, None, "")),
        ((c("n_entities") == 0) & (c("route") != "llm_only"), ("llm_only", 0.74, "no_entities_after_primary_route")),
        ((c("n_entities") > 0) & (c("n_relations") == 0) & (c("route") == "natasha_only"), ("ensemble", 0.70, "entities_without_relations")),
        ((c("result_confidence") < 0.55) & (c("route") != "ensemble"), ("ensemble", 0.73, "low_confidence_fallback")),
    ]
    pick = lambda k, last: F.coalesce(_chain([(t, v[k]) for t, v in rules], last), F.lit(last) if last is not None else F.lit(None))
    return decided.withColumns({
        "next_route": F.coalesce(pick(0, None), c("route")), "next_confidence": F.coalesce(pick(1, None), c("route_confidence")), "fallback_reason": pick(2, ""),
    })
