"""The test tables read as careers.

customer = person and session; order = job; order year = document; lineitem =
a skill named in a job, spelled in three ways; supplier = organization. Lines
flagged R are claimed skills, the others used technologies. ``documents`` are
uploads and ``events`` the status feed.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom import vocab as V
from careerloom.operators import analyze, graph, normalize, sessions, taxonomy
from careerloom.operators.common import KEY, keep
from careerloom.runtime import cut, discard, measured_broadcasts, scratch, shared_dir, size_of
from careerloom.streaming import feeds

AS_OF = "2001-01-01"
_STORED: dict[tuple[str, str], DataFrame] = {}


def _sv(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix), *[F.col(c).cast("string") for c in cols])


class Careers:
    """Lazily built frames over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._kept = spark, sf_dir, set()
        # Two tables that lie by session are joined by session and id where they lie.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        measured_broadcasts(spark)

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def store(self, *names: str) -> Careers:
        """Write frames that a query reads several times to tables, as a deployment would have them."""
        for name in names:
            if name in self._kept:
                continue
            self._kept.add(name)
            df = getattr(self, name)
            self.__dict__[name] = keep(df, self.buckets, placed=name == "raw_refs") if KEY in df.columns else cut(df)
        return self

    @cached_property
    def buckets(self) -> int:
        """Sessions are dealt to one bucket per 2 MB of lineitem, their largest table: about 20 MB of graph each."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return min(50_000, max(parts, size_of(self.t("lineitem")) // (2 << 20)))

    @property
    def as_of(self) -> Column:
        return F.to_date(F.lit(AS_OF))

    # ------------------------------------------------------------ raw records

    @cached_property
    def docs(self) -> DataFrame:
        year = F.year("o_orderdate")
        return (
            self.t("orders")
            .select(F.col("o_custkey").alias("session_id"), year.alias("year"))
            .distinct()
            .select("session_id", F.concat(_sv("d", "session_id"), F.lit("-"), F.col("year").cast("string")).alias("doc_id"), "year")
        )

    def _doc(self) -> Column:
        return F.concat(_sv("d", "o_custkey"), F.lit("-"), F.year("o_orderdate").cast("string"))

    @cached_property
    def line(self) -> DataFrame:
        orders = self.t("orders").select(
            "o_orderkey", F.col("o_custkey").alias("session_id"), F.year("o_orderdate").alias("year")
        )
        doc = F.concat(_sv("d", "session_id"), F.lit("-"), F.col("year").cast("string"))
        variant = F.col("l_linenumber") % 3
        raw = (
            F.when(variant == 0, F.upper("p_name"))
            .when(variant == 1, F.col("p_name"))
            .otherwise(F.replace("p_name", F.lit(" "), F.lit("%20")))
        )
        return (
            self.t("lineitem")
            .select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.t("part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
            # Rows move while they are narrow.
            .repartition(self.buckets, KEY)
            .select(
                "session_id", doc.alias("doc_id"), "year", _sv("j", "o_orderkey").alias("job_id"), "p_name", "p_type", "p_brand", "p_size",
                raw.alias("raw_label"), variant.alias("variant"), F.col("l_returnflag").alias("flag"), "l_linenumber",
            )
        )

    @cached_property
    def job(self) -> DataFrame:
        lines = self.t("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supp"), F.count("*").alias("n"))
        status, start = F.col("o_orderstatus"), F.to_date("o_orderdate")
        done = F.array(_sv("Closed order ", "o_orderkey"), _sv("Reached ", "o_orderpriority"), F.lit("Kept the schedule"))
        return (
            self.t("orders")
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .withColumnRenamed("o_custkey", KEY)
            .repartition(self.buckets, KEY)
            .withColumn("o_custkey", F.col(KEY))
            .select(
                KEY,
                self._doc().alias("doc_id"),
                _sv("j", "o_orderkey").alias("job_id"),
                F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 4 == 1, "s").when(F.col("o_orderkey") % 4 == 2, " I").otherwise("")).alias("title"),
                _sv("s", "supp").alias("org_id"),
                start.alias("start_date"),
                F.when(status != "O", F.date_add(start, (30 * (1 + F.coalesce("n", F.lit(0)))).cast("int"))).alias("end_date"),
                (status == "O").alias("is_current"),
                F.when(status == "F", done)
                .when(status == "P", F.array(_sv("Opened order ", "o_orderkey")))
                .otherwise(F.array().cast("array<string>"))
                .alias("achievements"),
                F.when(status == "F", 1.0).when(status == "P", 0.8).otherwise(0.6).alias("confidence"),
                F.concat(self._doc(), F.lit(".txt")).alias("source_doc"),
                F.make_timestamp_ntz(F.year("o_orderdate"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"),
                F.col("o_orderkey").alias("pos"),
                status.alias("status"),
                F.lit(None).cast("string").alias("location"),
                F.lit(None).cast("string").alias("description"),
            )
        )

    @staticmethod
    def _created() -> Column:
        return F.make_timestamp_ntz("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("created_at")

    @staticmethod
    def _uri(name: Column) -> Column:
        first, last = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
        topic = F.when(first.isin("hot", "cold"), F.concat(F.lit("temperature "), last)).otherwise(name)
        return F.when(first != "old", F.concat(F.lit("urn:skill:"), F.md5(topic)))

    @staticmethod
    def _skill_id() -> Column:
        return F.concat_ws(":", "doc_id", F.col("variant").cast("string"), F.replace("p_name", F.lit(" "), F.lit("-")))

    @cached_property
    def raw_skill(self) -> DataFrame:
        """Declared skills, and those a job named that got a record of their own."""
        last = F.substring_index("p_name", " ", -1)
        none = F.array().cast("array<string>")
        is_claim = F.col("flag") == "R"
        return (
            self.line.filter(is_claim | (F.col("variant") != 2))
            .groupBy("session_id", "doc_id", "year", "p_name", "variant", "raw_label")
            .agg(
                F.max(is_claim).alias("declared"), F.min("p_type").alias("t"), F.min("p_brand").alias("b"), F.max("p_size").alias("z"),
            )
            .select(
                "session_id", "doc_id", self._skill_id().alias("skill_id"), F.col("raw_label").alias("label"), "declared",
                F.when(F.col("declared"), F.nullif("t", F.lit("PROMO"))).otherwise("Technical").alias("category"),
                F.when(F.col("declared"), F.col("b")).alias("proficiency_level"),
                F.when(F.col("declared"), F.col("z") / 10.0).alias("years_experience"),
                self._uri(F.col("p_name")).alias("skos_uri"),
                F.when(F.col("z") >= 25, F.array(last)).otherwise(none).alias("broader_concepts"),
                F.when(F.col("z") % 7 == 0, F.array(F.concat(F.lit("fine_"), last), F.concat(F.lit("coarse_"), last))).otherwise(none).alias("narrower_concepts"),
                none.alias("related_concepts"),
                F.when(F.col("variant") == 2, F.array(F.concat("p_name", F.lit(" (alt)")))).otherwise(none).alias("alt_labels"),
                ((F.col("z") >= 48) & (F.col("variant") == 1)).alias("user_verified"),
                F.when(F.col("variant") == 0, 0.95).when(F.col("variant") == 1, 1.0).otherwise(0.65).alias("confidence"),
                F.concat("doc_id", F.lit(".txt")).alias("source_doc"), self._created(),
                F.col("variant").alias("pos"), F.lit(None).cast("string").alias("definition"),
            )
        )

    @cached_property
    def raw_tech(self) -> DataFrame:
        return self.line.filter("flag <> 'R'").select("session_id", "job_id", F.col("l_linenumber").alias("pos"), F.col("raw_label").alias("label"))

    @cached_property
    def job_skill(self) -> DataFrame:
        kind = F.when(F.col("flag") == "A", "skill").otherwise("technology")
        return self.line.filter("flag <> 'R'").select("session_id", "job_id", self._skill_id().alias("skill_id"), kind.alias("kind"))

    @cached_property
    def raw_org(self) -> DataFrame:
        k = F.col("s_suppkey")
        base = (k % 20).cast("string")
        style = F.floor(k / 20) % 4
        name = (
            F.when(style == 0, F.concat(F.lit("Supplier "), base, F.lit(", Inc.")))
            .when(style == 1, F.concat(F.lit("Supplier "), base, F.lit(" LLC")))
            .when(style == 2, F.concat(F.lit("The Supplier "), base, F.lit(" Corp.")))
            .otherwise(F.concat(F.lit("supplier "), base))
        )
        firms = self.t("supplier").select(_sv("s", "s_suppkey").alias("org_id"), name.alias("name"), F.lit("Company").alias("org_type"), k.cast("long").alias("pos"))
        used = self.job.filter("org_id is not null").select("session_id", "doc_id", "org_id").distinct().join(firms, "org_id")
        schools = (
            self.t("nation").filter("n_nationkey % 5 <> 0")
            .select(_sv("u", "n_nationkey").alias("org_id"), _sv("University of ", "n_name").alias("name"), F.lit("University").alias("org_type"), F.lit(1000000000).cast("long").alias("pos"))
        )
        attended = self.raw_edu.select("session_id", "doc_id", F.col("institution_id").alias("org_id")).join(schools, "org_id")
        none = F.lit(None).cast("string")
        return used.unionByName(attended).select(
            "session_id", "doc_id", "org_id", "name", "org_type", "pos", F.lit(0.9).alias("confidence"),
            F.concat("doc_id", F.lit(".txt")).alias("source_doc"),
            F.make_timestamp_ntz(F.substring_index("doc_id", "-", -1).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"),
            none.alias("industry"), none.alias("location"), none.alias("website"), none.alias("description"),
        )

    @cached_property
    def _doc_person(self) -> DataFrame:
        c = self.t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        n = self.t("nation").join(self.t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            self.docs.join(c, F.col("session_id") == F.col("c_custkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        )

    @cached_property
    def raw_edu(self) -> DataFrame:
        degree = F.when(F.col("year") % 2 == 0, F.col("c_mktsegment")).otherwise(F.initcap("c_mktsegment"))
        none = F.lit(None)
        return self._doc_person.select(
            "session_id", "doc_id", _sv("e", "doc_id").alias("edu_id"),
            F.concat("c_mktsegment", F.lit(" in "), "r_name").alias("label"), degree.alias("degree_type"),
            F.col("r_name").alias("field_of_study"), _sv("u", "n_nationkey").alias("institution_id"),
            none.cast("date").alias("start_date"), none.cast("date").alias("end_date"), F.lit(False).alias("is_current"),
            none.cast("string").alias("location"), none.cast("string").alias("description"), none.cast("double").alias("gpa"),
            F.lit(1.0).alias("confidence"), F.concat("doc_id", F.lit(".txt")).alias("source_doc"), self._created(), F.lit(0).alias("pos"),
        )

    @cached_property
    def raw_cert(self) -> DataFrame:
        seg = self.t("customer").select(F.col("c_custkey").alias("session_id"), "c_mktsegment")
        return self.job.filter("status = 'F'").join(seg, "session_id").select(
            "session_id", "doc_id", F.concat(F.lit("c"), F.substring("job_id", 2, 40)).alias("cert_id"),
            _sv("Certified ", "title").alias("name"), F.col("c_mktsegment").alias("issuing_organization"),
            F.col("start_date").alias("issue_date"), F.date_add("start_date", 730).alias("expiration_date"),
            F.lit(None).cast("string").alias("credential_id"), F.lit(None).cast("string").alias("credential_url"),
            F.lit(True).alias("is_active"), F.lit(0.85).alias("confidence"), "source_doc", "created_at", "pos",
        )

    @cached_property
    def raw_person(self) -> DataFrame:
        return self._doc_person.select(
            "session_id", "doc_id", _sv("p", "doc_id").alias("person_id"), F.col("c_name").alias("name"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
            F.lit(None).cast("string").alias("phone"), F.col("n_name").alias("location"), F.lit(None).cast("string").alias("summary"),
            F.lit(1.0).alias("confidence"), F.concat("doc_id", F.lit(".txt")).alias("source_doc"), self._created(),
        )

    @cached_property
    def raw_refs(self) -> DataFrame:
        """References of each document's person; open orders name a certificate nobody issued."""
        part = lambda df, kind, c: df.select("session_id", _sv("p", "doc_id").alias("person_id"), F.lit(kind).alias("kind"), F.col(c).alias("id"))
        pending = self.job.filter("status = 'P'").withColumn("cert_id", F.concat(F.lit("c"), F.substring("job_id", 2, 40)))
        return (
            part(self.job, "job", "job_id")
            .unionByName(part(self.raw_skill.filter("declared"), "skill", "skill_id"))
            .unionByName(part(self.raw_edu, "education", "edu_id"))
            .unionByName(part(self.raw_cert, "certification", "cert_id"))
            .unionByName(part(pending, "certification", "cert_id"))
        )

    # ------------------------------------------------------------ graph

    @cached_property
    def merged_person(self) -> DataFrame:
        return sessions.merge_persons(self.raw_person)

    @cached_property
    def merged_refs(self) -> DataFrame:
        return sessions.merged_references(self.raw_refs, self.raw_person)

    def _graph_of(self, build, **options):
        self.store("line", "job", "raw_skill", "raw_edu", "raw_org", "raw_cert", "raw_person", "raw_refs", "merged_person")
        return build(
            self.merged_person, self.merged_refs, self.job, self.job_skill, self.raw_skill, self.raw_edu,
            self.raw_cert, self.raw_org, self.as_of, buckets=self.buckets, **options,
        )

    def build_triples(self) -> DataFrame:
        return self._graph_of(graph.build_graph)

    def _stored_graph(self) -> DataFrame:
        """The graph, written part by part; records go with the last part that reads them."""
        behind = {"skills": "raw_skill", "organizations": "raw_org", "job_skill": "line", "jobs": "job"}
        return graph.store_parts(self._graph_of(graph.graph_parts, release=lambda name: discard(getattr(self, behind[name]))), self.buckets)

    @cached_property
    def triples(self) -> DataFrame:
        """The stored graph: built on first use in an application, then read while it runs."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _STORED:
            # Records and id maps that only the build reads go with it; frames of this object may read others.
            with scratch() as made:
                _STORED[key] = Careers(self.spark, self.dir)._stored_graph()
                made.remove(_STORED[key])
        return _STORED[key]

    @cached_property
    def org_map(self) -> DataFrame:
        return graph.dedup_orgs(self.raw_org)

    @cached_property
    def skill_map(self) -> DataFrame:
        return graph.dedup_skills(self.raw_skill)

    # ------------------------------------------------------------ labels

    @cached_property
    def labels(self) -> DataFrame:
        claims = self.raw_skill.filter("declared")
        return normalize.label_pools(claims, self.raw_tech, self.raw_org, self.raw_edu)

    @cached_property
    def alias_groups(self) -> DataFrame:
        """Two overlapping alias groups per session and kind of part: small -> large -> red."""
        last = F.substring_index("p_name", " ", -1)
        base = self.line.select("session_id", last.alias("w")).distinct()
        name = lambda p: F.concat(F.lit(p + " "), "w")
        big = lambda p: F.upper(name(p))
        group = lambda canon, *members: F.struct(
            big(canon).alias("canonical"), F.array(*[f(m) for m in members for f in (name, big)]).alias("members")
        )
        rows = F.array(group("large", "small", "large"), group("red", "large", "blue", "red"))
        return base.select("session_id", F.explode(rows).alias("g")).select(
            "session_id", F.lit("skill").alias("pool"), "g.canonical", "g.members", F.lit("same part").alias("reasoning")
        )

    @cached_property
    def label_map(self) -> DataFrame:
        self.store("line", "labels")
        return normalize.build_label_map(self.labels, self.alias_groups)

    # ------------------------------------------------------------ clean career frames

    @cached_property
    def persons(self) -> DataFrame:
        return self.t("customer").select(
            F.col("c_custkey").alias("session_id"), F.col("c_name").alias("person_name"),
            F.concat(_sv("customer-", "c_custkey"), F.lit(".md")).alias("source_document"),
        )

    @cached_property
    def skill(self) -> DataFrame:
        last = F.substring_index("p_name", " ", -1)
        none = F.array().cast("array<string>")
        return (
            self.line.filter("flag = 'R'")
            .groupBy("session_id", "p_name")
            .agg(F.min("p_type").alias("t"), F.min("p_brand").alias("b"), F.max("p_size").alias("z"))
            .select(
                "session_id", F.replace("p_name", F.lit(" "), F.lit("-")).alias("skill_id"), F.col("p_name").alias("label"),
                F.nullif("t", F.lit("PROMO")).alias("category"), F.col("b").alias("proficiency_level"),
                self._uri(F.col("p_name")).alias("skos_uri"),
                F.when(F.col("z") >= 25, F.array(last)).otherwise(none).alias("broader_concepts"),
                F.when(F.col("z") % 7 == 0, F.array(F.concat(F.lit("fine_"), last), F.concat(F.lit("coarse_"), last))).otherwise(none).alias("narrower_concepts"),
            )
        )

    @cached_property
    def tech_ref(self) -> DataFrame:
        bare = F.replace("p_name", F.lit(" "), F.lit("-"))
        ref = F.when(F.col("variant") == 0, F.concat(F.lit(V.RES), bare)).when(F.col("variant") == 1, bare).otherwise(F.col("p_name"))
        return self.line.filter("flag <> 'R'").select("session_id", "job_id", ref.alias("ref"))

    @cached_property
    def tech(self) -> DataFrame:
        return analyze.resolve_tech(self.tech_ref, self.skill)

    @cached_property
    def nodes(self) -> DataFrame:
        part = lambda df, c: df.select("session_id", F.col(c).alias("id"))
        return part(self.persons, "person_name").unionByName(part(self.job, "job_id")).unionByName(part(self.skill, "skill_id"))

    # ------------------------------------------------------------ taxonomy

    @cached_property
    def taxonomy(self) -> DataFrame:
        first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
        direct = ~first.isin("hot", "cold")
        return self.t("part").select("p_name").distinct().filter(first != "old").select(
            F.concat(F.lit("urn:skill:"), F.md5("p_name")).alias("concept_uri"), F.col("p_name").alias("pref_label"),
            F.when(direct, F.concat(F.lit("urn:group:"), last)).alias("broader_uri"),
            F.when(first == "red", F.concat(F.lit("handle "), "p_name")).when(direct, F.concat(last, F.lit(" handling"))).alias("broader_label"),
            F.when(first != "cold", F.lit("urn:pillar:1")).alias("hierarchy_uri"),
            F.when(first != "cold", F.lit("manufacturing")).alias("hierarchy_label"),
        )

    @cached_property
    def taxonomy_labels(self) -> DataFrame:
        first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
        words = F.array(F.col("p_name"), last, F.lower("p_type"), F.concat(first, F.lit(" work")), F.substring("p_name", 1, 2))
        return self.t("part").select(F.explode(words).alias("label")).distinct()

    @cached_property
    def matches(self) -> DataFrame:
        return taxonomy.lookup(self.skill, self.taxonomy)

    def career_frames(self) -> dict[str, DataFrame]:
        return {
            "persons": self.persons, "jobs": self.job, "skills": self.skill, "tech": self.tech,
            "matches": self.matches, "nodes": self.nodes,
        }

    # ------------------------------------------------------------ uploads and feeds

    @cached_property
    def uploads(self) -> DataFrame:
        ext = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".md").when(F.col("lang") == "de", ".PDF").otherwise(".exe")
        return self.t("documents").select(
            F.col("source").alias("session_id"), F.col("doc_id").alias("document_id"),
            F.concat(_sv("file", "doc_id"), ext).alias("filename"),
            (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("upload_ts"),
            F.md5("text").alias("file_hash"),
        )

    @staticmethod
    def _as_events(df: DataFrame) -> DataFrame:
        kind = (
            F.when(F.col("event_type") == "signup", "started")
            .when(F.col("event_type") == "view", "progress")
            .when(F.col("event_type") == "click", "entity_extracted")
            .when(F.col("event_type") == "purchase", "complete")
            .otherwise("error")
        )
        return df.select(
            "event_id", "ts", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("session_id"),
            F.col("user_id").alias("document_id"), kind.alias("event"), F.col("props").alias("payload"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self._as_events(self.t("events"))

    def event_stream(self, parts: int = 4) -> DataFrame:
        """The events as a stream of ``parts`` batches in the order of their ids."""
        events = self.t("events").withColumn("ts", F.col("ts").cast("timestamp"))
        low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
        step = (high - low) // parts + 1
        folder = f"{shared_dir(self.spark)}/events-{uuid.uuid4().hex}"
        files = max(1, size_of(events) // parts // (32 << 20))
        for i in range(parts):
            part = events.filter((F.col("event_id") >= low + i * step) & (F.col("event_id") < low + (i + 1) * step))
            part.repartition(files).write.mode("append").parquet(folder)
        return self._as_events(self.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder))

    @cached_property
    def doc_status(self) -> DataFrame:
        return feeds.document_status(self.events)

    @cached_property
    def session(self) -> DataFrame:
        live = self.events.groupBy("session_id").agg(F.max("ts").alias("updated_at"))
        idle = self.t("nation").select(_sv("n", "n_nationkey").alias("session_id"), F.lit("2023-01-01").cast("timestamp_ntz").alias("updated_at"))
        return live.unionByName(idle)
