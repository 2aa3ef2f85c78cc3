"""Seeded synthetic data: documents, physicians, interactions, queries, judgments, metadata, image features.

Every value is a function of the row number, a seed and a name, so rows are made in parallel and repeat exactly. The
distributions follow the described data set; single values differ from those of any sequential generator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.analytics import index_of
from .bridge import ICD_CODES
from .tables import DOC_TYPES, Tables, first_wins

# The vocabulary of the data set.
SPECIALTIES = ("oncology", "cardiology", "neurology", "immunology", "endocrinology", "pulmonology", "nephrology", "hematology", "rheumatology", "gastroenterology")
SYNONYMS = {
    "cardiac_toxicity": ("cardiotoxicity", "cardiac adverse events", "TKI-induced cardiac events", "cardiovascular toxicity", "myocardial injury", "drug-induced cardiomyopathy", "cardiac dysfunction secondary to therapy"),
    "liver_damage": ("hepatotoxicity", "drug-induced liver injury", "hepatic failure", "liver function impairment", "DILI", "cholestatic injury", "transaminase elevation"),
    "immune_response": ("immunogenicity", "immune-mediated adverse reaction", "antibody-dependent response", "autoimmune activation", "cytokine storm", "immune checkpoint response", "hypersensitivity reaction"),
    "kidney_injury": ("nephrotoxicity", "acute kidney injury", "renal impairment", "glomerular filtration decline", "drug-induced nephropathy", "creatinine elevation", "tubular necrosis"),
    "blood_disorder": ("hematologic toxicity", "myelosuppression", "pancytopenia", "thrombocytopenia", "neutropenia", "anemia secondary to treatment", "bone marrow suppression"),
    "tumor_response": ("objective response rate", "tumor regression", "partial response", "complete remission", "disease control rate", "radiographic response", "RECIST criteria response"),
    "neurological_effects": ("neurotoxicity", "peripheral neuropathy", "cognitive impairment", "central nervous system effects", "encephalopathy", "chemotherapy-induced neuropathy", "neurodegeneration"),
}
# This engine's own vocabulary, of everyday medicine.
MEDICINES = ("metformin", "warfarin", "salbutamol", "levothyroxine", "amoxicillin", "prednisolone", "omeprazole", "furosemide", "allopurinol", "sertraline", "insulin glargine", "ramipril", "codeine", "lithium carbonate", "carbimazole", "digoxin", "sumatriptan")
ILLNESSES = ("asthma", "type 2 diabetes", "atrial fibrillation", "gout", "migraine", "coeliac disease", "iron deficiency", "hypothyroidism", "psoriasis", "chronic bronchitis", "sciatica", "ulcerative colitis", "sleep apnoea")
GROUPS = ("statin", "beta blocker", "loop diuretic", "macrolide", "opioid", "antihistamine", "proton pump blocker", "corticosteroid", "vitamin K antagonist")
ORGANS = ("thyroid", "spleen", "stomach", "bladder", "pancreas", "tonsil", "gallbladder", "larynx", "adrenal gland")
SETTINGS = ("a village surgery", "two teaching hospitals", "an emergency ward", "a home care service", "a rural clinic", "an outpatient unit", "a rehabilitation centre")
TESTS = ("ferritin", "peak flow", "fasting glucose", "urate", "thyrotropin", "blood pressure", "bone density")
# Kinds of interaction with their shares, and the shares of linked interactions and of the own specialty.
KINDS = (("view", 0.5), ("click", 0.25), ("save", 0.1), ("dwell", 0.15))
LINKED, OWN_SPECIALTY, ZIPF, JUDGED = 0.6, 0.7, 1.5, 20

# This engine's own wording: for each document type some texts, with the slots that filled() replaces; {remark} is one of REMARKS.
TEXTS = {
    "trial_report": (
        "Between January and autumn, {setting} tested {medicine} against usual care for {illness}. {n} people were drawn by lot into stage {phase}. {remark} {test} changed by {pct} units on average, and {few} people left early.",
        "Does {medicine} help in {illness}? We followed {n} volunteers for {weeks} weeks, half of them on placebo. {remark} The difference in {test} was small but steady.",
        "Stage {phase} results, {medicine}, {illness}. Dose steps were reached by {pct} of every hundred people. {remark} The safety board met {few} times and let the work go on.",
    ),
    "case_study": (
        "At {age}, a retired teacher came to {setting} because of {illness}. She had taken {medicine} since the spring. {remark} {weeks} weeks later her {test} was back to normal.",
        "A bus driver of {age} years stopped {medicine} on his own. His {illness} returned within days. {remark} We restarted the tablets at half strength and saw him {few} times.",
        "The family noticed it first: tiredness, then a rash, at the age of {age}. {illness} had been known for years. {remark} Nothing but {medicine} was new.",
    ),
    "drug_interaction": (
        "Pharmacists of {setting} looked at everyone who takes {medicine} and {second} together. {remark} Of {n} such people {pct} needed another dose.",
        "{second} slows the breakdown of {medicine}. {remark} Whoever needs both for {illness} should have {test} measured every {few} weeks.",
        "Question from a reader: may {medicine} be combined with {second}? Answer: yes, with care. {remark} Leave {few} hours between the two.",
    ),
    "pathology_report": (
        "Material: {organ}, {few} blocks. History of {illness}. Under the microscope the border is smooth and {pct} of a hundred cells are dividing. {remark}",
        "Received in formalin, a piece of {organ} of {n} milligrams. {remark} Stains were read by two people who agreed in {pct} of a hundred fields.",
        "Second opinion on slides of the {organ}. We see scarring that fits {illness}. {remark} No further cuts are needed.",
    ),
    "cohort_summary": (
        "All {n} patients whom {setting} treated for {illness} were traced through the register. {pct} of a hundred took {medicine}. {remark} The median time under observation was {weeks} weeks.",
        "Linking pharmacy and hospital records gave {n} users of {medicine}. {remark} Those above the age of {age} stayed in hospital {few} days longer.",
        "Ten years of {illness} in one county. {remark} {test} at the start told best who would need {medicine} again.",
    ),
}
REMARKS = (
    "Nurses wrote down {term} on most visits.", "One question stayed open, whether {term} came from the tablets.", "We had not expected {term} so soon.", "{term} led to a change of plan.", "Relatives asked about {term} before we did.",
    "Neither age nor weight explained {term}.", "The notes mention {term} twice.", "Looking back, {term} was the first warning.", "Later, {term} went away without help.",
)
SEARCHES = (
    "how common is {term}", "{medicine} dose in old age", "{term} after {medicine}", "can {medicine} be taken with {second}", "{illness} and {test}", "what helps against {illness} at night", "{organ} biopsy meaning", "stopping {medicine} safely",
    "first choice {group} for {illness}", "{illness} in {setting}", "{test} too high {medicine}", "signs of {term}", "{group} or {medicine}", "{illness} long term outlook", "stage {phase} study {illness} {medicine}", "{organ} scarring causes",
    "{term} when to worry", "{medicine} and alcohol", "{group} side effects {term}", "diet for {illness}", "{second} instead of {medicine}", "who should not take {group}",
)


@dataclass
class Config:
    """Sizes of a data set; the data section of a configuration file."""

    num_documents: int = 1000
    num_physicians: int = 500
    num_queries: int = 2000
    num_interactions: int = 75_000

    @classmethod
    def read(cls, path: str) -> Config:
        """Reads the data section of a two-level YAML file (key: value lines)."""
        found, inside = {}, False
        for line in Path(path).read_text().splitlines():
            body = line.split("#")[0].rstrip()
            if body and not body.startswith(" "):
                inside = body == "data:"
            elif inside and ":" in body:
                k, v = (x.strip() for x in body.split(":", 1))
                if k in cls.__dataclass_fields__:
                    found[k] = int(v.replace("_", ""))
        return cls(**found)


def uniform(seed: int, name: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed, name and keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(1 << 52)) / float(1 << 52)


def pick(values: tuple, seed: int, name: str, *keys: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform(seed, name, *keys) * len(values)) + 1).cast("int"))


def whole(low: int, high: int, seed: int, name: str, *keys: Column) -> Column:
    """An integer in [low, high]."""
    return (low + F.floor(uniform(seed, name, *keys) * (high - low + 1))).cast("int")


def _moment(seed: int, name: str, i: Column, hours: bool = True) -> Column:
    days = whole(0, 1095, seed, name + "d", i)
    h, m = (whole(8, 18, seed, name + "h", i), whole(0, 59, seed, name + "m", i)) if hours else (F.lit(0), F.lit(0))
    return F.timestamp_seconds(F.lit(1609459200).cast("long") + days.cast("long") * 86400 + h * 3600 + m * 60)  # 2021-01-01


def _term(seed: int, i: Column) -> Column:
    return pick(tuple(t for ts in SYNONYMS.values() for t in ts), seed, "term", i)


def _words(seed: int, name: str, i: Column) -> dict[str, Column]:
    lists = {"second": MEDICINES, "setting": SETTINGS, "test": TESTS, "organ": ORGANS, "group": GROUPS}
    return {k: pick(v, seed, name + k, i) for k, v in lists.items()}


def documents(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    d = spark.range(n).withColumnRenamed("id", "i")
    i = F.col("i")
    kind = F.element_at(F.array(*map(F.lit, DOC_TYPES)), (i % len(DOC_TYPES) + 1).cast("int"))
    d = d.withColumn("doc_type", kind).withColumn("illness", pick(ILLNESSES, seed, "illness", i)).withColumn("medicine", pick(MEDICINES, seed, "medicine", i))
    text = F.element_at(F.create_map(*(x for t, texts in TEXTS.items() for x in (F.lit(t), pick(texts, seed, "text", i)))), F.col("doc_type"))
    slots = {"phase": pick(("I", "II", "III"), seed, "phase", i), "medicine": F.col("medicine"), "illness": F.col("illness")} | _words(seed, "", i)
    slots |= {k: whole(lo, hi, seed, k, i).cast("string") for k, lo, hi in (("n", 60, 3000), ("pct", 2, 70), ("age", 20, 88), ("weeks", 3, 150), ("few", 2, 9))}
    body = S.filled(text, {"remark": S.filled(pick(REMARKS, seed, "remark", i), {"term": _term(seed, i)}), **slots})
    codes = F.array_distinct(F.array(*(pick(ICD_CODES, seed, f"icd{k}", i) for k in range(3))))
    codes = F.slice(codes, 1, F.least(F.size(codes), whole(1, 3, seed, "codes", i)))
    return d.select(
        S.hashed_id(F.concat(F.lit("doc_"), F.col("doc_type"), F.lit("_"), i.cast("string"))).alias("doc_id"), F.concat_ws(": ", "illness", "medicine").alias("title"),
        pick(SPECIALTIES, seed, "spec", i).alias("specialty"), "doc_type", body.alias("body_text"), _moment(seed, "doc", i, False).alias("created_at"), F.array_join(codes, ",").alias("icd_codes"),
    )


def physicians(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(S.padded_id("PHY-", 4, i).alias("physician_id"), pick(SPECIALTIES, seed, "pspec", i).alias("specialty"), whole(1, 35, seed, "years", i).alias("years_experience"))


def interactions(spark: SparkSession, docs: DataFrame, n_docs: int, people: DataFrame, n_people: int, n: int, seed: int = 42) -> DataFrame:
    """OWN_SPECIALTY of the draws are uniform inside the physician's specialty, the rest follow Zipf weights.

    Draws meet documents in equi-joins: on (specialty, position) or, for the Zipf part, on a document's global position,
    which inverts the cumulative weight of the continuous law.
    """
    i = F.col("interaction_id")
    base = spark.range(n).select(F.col("id").alias("interaction_id"))
    base = base.withColumn("physician_id", S.padded_id("PHY-", 4, F.floor(uniform(seed, "who", i) * n_people).cast("long")))
    base = base.join(people.select("physician_id", "specialty"), "physician_id")
    at = docs.select("doc_id", "specialty")
    ordered = index_of(at.select(F.struct("specialty", "doc_id").alias("k")), "k").select("k.specialty", "k.doc_id", "idx")
    sizes = ordered.groupBy("specialty").agg(F.count("*").alias("size"), F.min("idx").alias("first"))
    in_spec = ordered.join(F.broadcast(sizes), "specialty").select("specialty", "doc_id", (F.col("idx") - F.col("first")).alias("pos"))
    sizes = sizes.drop("first")
    base = base.join(F.broadcast(sizes), "specialty", "left")  # one row a specialty
    own = (uniform(seed, "own", i) < OWN_SPECIALTY) & F.col("size").isNotNull()
    base = base.withColumn("own", own).withColumn("pos", F.floor(uniform(seed, "pos", i) * F.col("size")).cast("int"))
    # popularity rank by inverting the truncated Pareto law with the Zipf exponent, ranks shuffled over documents
    tail = 1 - ZIPF
    rank = F.floor(F.pow(1 - uniform(seed, "zipf", i) * (1 - float(max(n_docs, 1) + 1) ** tail), F.lit(1 / tail))).cast("int")
    base = base.withColumn("rank", F.least(rank, F.lit(n_docs)))
    popular = index_of(at.select(F.struct(F.xxhash64(F.lit(seed), "doc_id").alias("h"), "doc_id").alias("k")), "k").select((F.col("idx") + 1).alias("rank"), "k.doc_id")
    drawn = base.where("own").join(in_spec.select("specialty", "pos", "doc_id"), ["specialty", "pos"]).select("interaction_id", "physician_id", "doc_id")
    drawn = drawn.union(base.where("not own").join(popular, "rank").select("interaction_id", "physician_id", "doc_id"))
    u, kind, upto = uniform(seed, "kind", i), F, 0.0
    for name, share in KINDS[:-1]:
        upto += share
        kind = kind.when(u < upto, name)
    kind = kind.otherwise(KINDS[-1][0])
    d = drawn.withColumn("interaction_type", kind)
    between = lambda lo, hi: F.round(lo + uniform(seed, "dwell", i) * (hi - lo), 1)
    dwell = F.when(F.col("interaction_type") == "dwell", between(5.0, 300.0)).when(F.col("interaction_type").isin("click", "save"), between(2.0, 60.0))
    return d.select("interaction_id", "physician_id", "doc_id", "interaction_type", dwell.alias("dwell_time_seconds"), _moment(seed, "int", i).alias("timestamp"), F.lit(None).cast("string").alias("query_id"))


def search_queries(spark: SparkSession, n: int, n_people: int, seed: int = 42) -> DataFrame:
    i = F.col("id")
    slots = {"medicine": pick(MEDICINES, seed, "qmedicine", i), "illness": pick(ILLNESSES, seed, "qillness", i), "phase": pick(("I", "II", "III"), seed, "qphase", i), "term": _term(seed + 1, i)} | _words(seed, "q", i)
    return spark.range(n).select(S.padded_id("QRY-", 6, i).alias("query_id"), S.padded_id("PHY-", 4, F.floor(uniform(seed, "qwho", i) * n_people).cast("long")).alias("physician_id"), S.filled(pick(SEARCHES, seed, "search", i), slots).alias("query_text"), _moment(seed, "qry", i).alias("timestamp"))


def linked(rows: DataFrame, n_queries: int, share: float = LINKED, seed: int = 42) -> DataFrame:
    """Links a share of the interactions to queries."""
    i = F.col("interaction_id")
    q = S.padded_id("QRY-", 6, F.floor(uniform(seed, "link", i) * n_queries).cast("long"))
    return rows.withColumn("query_id", F.when(uniform(seed, "linked", i) < share, q))


def judgments(queries: DataFrame, docs: DataFrame, n_docs: int, per_query: int = JUDGED, seed: int = 42, noise: bool = True) -> DataFrame:
    """Grades of documents drawn for each query: whitespace-token overlap, a chance bonus and noise."""
    per_query = min(per_query, n_docs)
    at = docs.select("doc_id", "body_text").join(index_of(docs, "doc_id").withColumnRenamed("idx", "pos"), "doc_id")
    start = F.floor(uniform(seed, "jstart", F.col("query_id")) * n_docs)
    # a stride coprime to the number of documents draws different ones
    stride = next(s for s in range(max(1, int(n_docs * 0.382)), n_docs + 2) if np.gcd(s, n_docs) == 1) if n_docs > 1 else 1
    q = queries.select("query_id", "query_text", F.explode(F.sequence(F.lit(0), F.lit(per_query - 1))).alias("arrival"))
    q = q.withColumn("pos", F.pmod(start + F.col("arrival").cast("long") * stride, F.lit(n_docs)).cast("int")).join(at, "pos")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.col(c)), "\\s+"), lambda w: w != ""))
    base = 2 * F.size(F.array_intersect(words("query_text"), words("body_text"))) / F.greatest(F.size(words("query_text")), F.lit(1))
    if noise:
        k = (F.col("query_id"), F.col("doc_id"))
        base = base + F.when(uniform(seed, "bonus", *k) < 0.3, 0.5).otherwise(0.0) + uniform(seed, "noise", *k) * 0.8 - 0.3
    return q.select("query_id", "doc_id", S.grade(base).alias("relevance_score"), "arrival")


def structured_metadata(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, lab_values, biomarker_levels, icd_codes_list, word_count): 3-8 labs and 1-5 markers a document."""
    from ..operators.embeddings import LABS, MARKERS

    i = F.col("doc_id")

    def chosen(names: tuple[str, ...], low: int, high: int, name: str, top: float, digits: int) -> Column:
        keyed = F.array_sort(F.array(*(F.struct(F.xxhash64(F.lit(seed), F.lit(name + n), i).alias("h"), F.lit(n).alias("n")) for n in names)))
        keys = F.transform(F.slice(keyed, 1, whole(low, high, seed, name, i)), lambda x: x["n"])
        return F.map_from_arrays(keys, F.transform(keys, lambda n: F.round(F.pmod(F.xxhash64(F.lit(seed + 1), n, i), F.lit(10_000)) / 10_000 * top, digits)))

    return docs.select("doc_id", chosen(tuple(n.replace("_", " ") for n in LABS), 3, 8, "lab", 15.0, 2).alias("lab_values"), chosen(tuple(n.replace("_", " ") for n in MARKERS), 1, 5, "marker", 100.0, 1).alias("biomarker_levels"), F.split("icd_codes", ",").alias("icd_codes_list"), S.word_count(F.col("body_text")).alias("word_count"))


def image_vectors(ids, width: int = 2048, seed: int = 42) -> np.ndarray:
    """Gaussian vectors of unit length, seeded by id."""
    import zlib

    out = np.empty((len(ids), width), np.float32)
    for i, d in enumerate(ids):
        x = np.random.default_rng([seed, zlib.crc32(str(d).encode())]).standard_normal(width)
        out[i] = x / np.linalg.norm(x)
    return out


def image_features(docs: DataFrame, width: int = 2048, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, vec): Gaussian vectors of unit length, seeded by doc_id."""

    @F.pandas_udf("array<float>")
    def make(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            for a in range(0, len(s), 256):  # given back at once: a batch of ids is far smaller than its vectors
                yield pd.Series(list(image_vectors(s.iloc[a : a + 256], width, seed)), dtype=object)

    return docs.select("doc_id", *keep, make("doc_id").alias("vec"))


def dataset(spark: SparkSession, config: Config, seed: int = 42) -> Tables:
    """All five tables; judgments keep the first arrival of each key."""
    docs, people = documents(spark, config.num_documents, seed), physicians(spark, config.num_physicians, seed)
    queries = search_queries(spark, config.num_queries, config.num_physicians, seed)
    rows = linked(interactions(spark, docs, config.num_documents, people, config.num_physicians, config.num_interactions, seed), config.num_queries, seed=seed)
    judged = first_wins(judgments(queries, docs, config.num_documents, seed=seed), ["query_id", "doc_id"], "arrival").drop("arrival")
    return Tables(docs, people, rows, queries, judged)
