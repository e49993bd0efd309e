"""The research questions as functions of one research corpus; each is a DataFrame plan over its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.operators import commentary, evidence, finding, glossary, lexical, relations, renderings, reuse, segments


@dataclass(frozen=True)
class Research:
    """Tables of a corpus; those that a question doesn't need may be missing.

    corpus: segments, chunks, vectors. works (work, title, person, date_start, date_end), relations (source, target, ref, relation, method,
    at), alignments (work, first, last, gloss, length, reviewed, commentary), renderings (work, ordinal, translator, lang, text, tier),
    people (person, name, teacher), witnesses (work, witness, ordinal, text), quotations (a_doc, a_start, b_doc, b_start, length),
    readings (form, reading), entries (term, rendering, rejected, verified)."""

    corpus: finding.Corpus
    works: DataFrame | None = None
    relations: DataFrame | None = None
    alignments: DataFrame | None = None
    renderings: DataFrame | None = None
    people: DataFrame | None = None
    witnesses: DataFrame | None = None
    quotations: DataFrame | None = None
    readings: dict[str, str] | None = None
    entries: DataFrame | None = None

    def search(self, query: str, mode: str = "hybrid", scope: lexical.Scope | None = None, limit: int = 20, wanted: DataFrame | None = None) -> DataFrame:
        return finding.search(self.corpus, query, mode, scope, limit, wanted)

    def search_translations(self, query: str, translators: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
        """work, ordinal, translator, text, occurrences, rank of renderings that hold the phrase."""
        rows = self.renderings.where(F.contains("text", F.lit(query)))
        if translators:
            rows = rows.where(F.col("translator").isin(*translators))
        rows = rows.select("work", "ordinal", "translator", "text", lexical.occurrences(F.col("text"), query).alias("occurrences"))
        return lexical.ranked(rows, [F.col("occurrences").desc(), F.col("work"), F.col("ordinal"), F.col("translator")], limit)

    def survey_corpus(self, query: str, top: int = 10) -> DataFrame:
        return lexical.survey(self.corpus.segments, query, top)

    def get_passage(self, doc_id: int, first: int, last: int, around: int = 0) -> DataFrame:
        """The text of a range of lines with its offsets and digest; a wider one with `around` lines on either side."""
        one = self.corpus.segments.sparkSession.createDataFrame([(doc_id, max(0, first - around), last + around)], "doc_id long, first long, last long")
        mine = self.corpus.segments.where(F.col("doc_id") == doc_id)
        if around:
            ends = mine.agg(F.max("ordinal").alias("end"))
            one = one.crossJoin(ends).select("doc_id", "first", F.least("last", "end").alias("last"))  # one row each
        return segments.resolve(mine, one)

    def get_outline(self, doc_id: int) -> DataFrame:
        """chunk_no, first_ordinal, last_ordinal, heading: the beginning of each chunk."""
        return self.corpus.chunks.where(F.col("doc_id") == doc_id).select("chunk_no", "first_ordinal", "last_ordinal", F.substring("content", 1, 60).alias("heading"))

    def get_commentaries(self, work) -> DataFrame:
        return self.relations.where((F.col("target") == work) & F.col("relation").isin(*commentary.UPWARD)).select("source", "relation", "method").distinct()

    def get_glosses(self, work, ordinal: int) -> DataFrame:
        line = self.alignments.sparkSession.createDataFrame([(work, ordinal)], self.alignments.select("work", F.lit(0).cast("long").alias("ordinal")).schema)
        return commentary.glosses_on(self.alignments, line)

    def get_commentary_outline(self, work, divisions: DataFrame) -> DataFrame:
        return commentary.alignment_outline(self.alignments.where(F.col("work") == work), divisions.where(F.col("work") == work))

    def compare_translators(self, work) -> DataFrame:
        """translator, lines, chars of each hand's renderings of a work."""
        return self.renderings.where(F.col("work") == work).groupBy("translator").agg(F.count_distinct("ordinal").alias("lines"), F.sum(F.length("text")).alias("chars"))

    def get_works_by_person(self, person) -> DataFrame:
        return self.works.where(F.col("person") == person)

    def get_person(self, person) -> DataFrame:
        """The chain of teachers from a person up, with names."""
        start = self.people.where(F.col("person") == person).select("person")
        chain = commentary.lineage(start, self.people.select("person", "teacher"))
        return chain.join(self.people.select("person", "name").distinct(), "person", "left")

    def get_parallels(self, work) -> DataFrame:
        other = self.relations.where(~F.col("relation").isin(*commentary.UPWARD))
        both = other.select(F.col("source").alias("a"), F.col("target").alias("b")).union(other.select("target", "source"))
        return both.where((F.col("a") == work) & F.col("b").isNotNull()).select(F.col("b").alias("work")).distinct()

    def compare_versions(self, work) -> DataFrame:
        asked = self.works.where(F.col("work") == work).select("work")
        parallels = self.relations.where("relation = 'parallel_to' and target is not null").select(F.col("source").alias("a"), F.col("target").alias("b"))
        return commentary.versions(asked, self.renderings, parallels, self.witnesses.select("work", F.col("witness").alias("edition")))

    def compare_witnesses(self, work) -> DataFrame:
        """ordinal, texts, agree: each line's readings over the witnesses of a work."""
        mine = self.witnesses.where(F.col("work") == work)
        return mine.groupBy("ordinal").agg(F.array_join(F.sort_array(F.collect_set("text")), " | ").alias("texts"), (F.count_distinct("text") == 1).alias("agree"))

    def get_quotations(self, doc_id: int, start: int, end: int) -> DataFrame:
        """other, other_start, length of quotations, at either end, that touch a passage."""
        a, b = (self.quotations.select(F.col(f"{x}_doc").alias("doc"), F.col(f"{x}_start").alias("at"), F.col(f"{y}_doc").alias("other"), F.col(f"{y}_start").alias("other_start"), "length") for x, y in (("a", "b"), ("b", "a")))
        return a.unionByName(b).where((F.col("doc") == doc_id) & (F.col("at") < end) & (F.col("at") + F.col("length") > start)).select("other", "other_start", "length")

    def get_readings(self, texts: DataFrame) -> DataFrame:
        return renderings.longest_match(texts, self.readings or {})

    def define_from_canon(self, term: str, formulae: tuple[str, ...], limit: int = 20) -> DataFrame:
        """Lines in which a term stands with a formula of definition."""
        found = F.lit(False)
        for f in formulae:
            found = found | F.contains("content", F.lit(f))
        hits = self.corpus.segments.where(F.contains("content", F.lit(term)) & found).select("doc_id", "ordinal", "content", F.length("content").alias("size"))
        return lexical.ranked(hits, [F.col("size"), F.col("doc_id"), F.col("ordinal")], limit).drop("size")

    def look_up(self, asked: DataFrame) -> DataFrame:
        return glossary.lookup(self.entries, asked)

    def resolve_root(self, starts: DataFrame) -> DataFrame:
        up = self.relations.where(F.col("relation").isin(*commentary.UPWARD)).select(F.col("source").alias("node"), F.col("target").alias("up"))
        return relations.walk_up(starts, up)

    def verify_citation(self, claims: DataFrame) -> DataFrame:
        return evidence.verify(claims, segments.addressed(self.corpus.segments))

    def verify_report(self, reports: DataFrame) -> DataFrame:
        """report_id, checked, failed, existence_only, status of reports (report_id, text): each citation with the quote before it."""
        found = evidence.occurrences(reports.select(F.col("report_id").alias("doc_id"), "text"))
        claims = found.select(F.concat_ws("/", "doc_id", "byte_start").alias("claim_id"), "urn", F.col("quoted").alias("quote"), F.col("doc_id").alias("report_id"))
        checked = self.verify_citation(claims.drop("report_id")).join(claims.select("claim_id", "report_id"), "claim_id")
        return evidence.report_status(checked, "report_id")

    def quoted_passages(self, passages: DataFrame, texts: DataFrame) -> DataFrame:
        return reuse.find_passages(passages, texts)
