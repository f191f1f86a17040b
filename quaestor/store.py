"""The domain's tables as DataFrames, and the queries that an application asks of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import interval, lookup, matrix, resolve, search, similarity
from quaestor.sources import framed
from quaestor.specs import FILES, INDEXES, KEYS, SCHEMAS, build, typed


class Store:
    """Tables by name, and views over them. Nothing is kept between calls but what the caller caches."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None, folder: str | None = None, files: Mapping[str, str] = FILES):
        """tables: DataFrames with the declared schemas; others are read from framed dumps {folder}/{files[name]}.json, missing ones are empty."""
        self.spark, self.folder, self.files = spark, folder, files
        self.tables = dict(tables or {})

    def table(self, name: str) -> DataFrame:
        """A table, with the last of documents that share a key."""
        if name not in self.tables:
            if self.folder is None:
                self.tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
            else:
                rows = self._read(name)
                key = KEYS[name]().alias("__key")
                last = rows.select(F.struct(*(c for c in rows.columns if c != "__pos")).alias("__row"), key, "__pos").groupBy("__key").agg(F.max_by("__row", "__pos").alias("__row"))
                self.tables[name] = last.select("__row.*")
        return self.tables[name]

    def _read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{self.files[name]}.json"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], SCHEMAS[name]).withColumn("__pos", F.lit(0))
        return framed.read(self.spark, path).select(typed(name, F.col("doc")).alias("r"), F.col("pos").alias("__pos")).select("r.*", "__pos")

    def index(self, name: str) -> DataFrame:
        if name == "activities_by_dossier":
            return self.activities_by_dossier()
        if name == "dossiers_by_member":
            return self.dossiers_by_member()
        return build(self.table(INDEXES[name].table), INDEXES[name])

    # look-ups

    def get(self, name: str, key: str | None = None) -> DataFrame:
        """The rows of an index or table under a key, or all."""
        if name in INDEXES or name in ("activities_by_dossier", "dossiers_by_member"):
            rows = self.index(name)
            return rows if key is None else rows.where(F.col("k").cast("string") == key)
        return self.table(name) if key is None else self.table(name).where(KEYS[name]() == key)

    def get_many(self, name: str, keys: Sequence[str]) -> DataFrame:
        """A row per key in order, nulls for misses."""
        return lookup.multi_get(self.table(name).withColumn("__key", KEYS[name]()), "__key", list(keys)).drop("__key")

    def keys(self, name: str, count: bool = False) -> DataFrame:
        """(key), or with counts (key, n): an index's postings, a table's top-level fields of each document that aren't null."""
        if name in INDEXES:
            found = self.index(name).groupBy(F.col("k").alias("key")).agg(F.count("*").alias("n"))
        else:
            t = self.table(name)
            fields = sum((F.col(f"`{c}`").isNotNull().cast("long") for c in t.columns), F.lit(0))
            found = t.select(KEYS[name]().alias("key"), fields.alias("n"))
        return found if count else found.select("key")

    def count(self, name: str, key: str | None = None) -> int:
        return self.get(name, key).count()

    def put(self, name: str, docs: DataFrame) -> None:
        """Upserts whole documents by key; new ones win."""
        both = self.table(name).withColumn("__new", F.lit(0)).unionByName(docs.withColumn("__new", F.lit(1)), allowMissingColumns=True)
        row = F.struct(*(f"`{c}`" for c in both.columns if c != "__new"))
        self.tables[name] = both.groupBy(KEYS[name]().alias("__key")).agg(F.max_by(row, "__new").alias("__row")).select("__row.*")

    # people

    def names(self, ids: Sequence[int]) -> DataFrame:
        return self.table("members").where(F.col("UserID").isin(*ids)).select("UserID", F.col("Name.full").alias("name"))

    def countries(self, ids: Sequence[int], date: str) -> DataFrame:
        """The constituency of each person at a date; those without one are left out."""
        found = interval.first_valid(F.col("Constituencies"), F.lit(date))
        return self.table("members").where(F.col("UserID").isin(*ids)).select("UserID", found.alias("c")).where("c is not null").select("UserID", "c.*")

    def resolve_name(self, probes: DataFrame) -> DataFrame:
        """(probe, member) for probes (probe, name, date, group, abbr); see operators.resolve."""
        m = self.index("members_by_name").select(F.col("k").alias("__name"), F.col("UserID").alias("member"), "Constituencies", "Groups")
        rows = probes.withColumn("__name", search.normal_name(F.col("name"))).join(m, "__name", "left")
        at = F.col("date")
        valid = F.exists("Constituencies", lambda c: (c["start"] <= at) & (at <= c["end"]))
        groups = F.filter("Groups", lambda g: (g["start"] <= at) & (at <= g["end"]))
        by_abbr = F.exists(groups, lambda g: g["groupid"] == F.col("abbr"))
        by_name = F.exists(groups, lambda g: g["Organization"] == F.col("group"))
        return resolve.resolve(rows, "probe", "member", valid, by_abbr, by_name, at.isNotNull())

    def active_groups(self) -> DataFrame:
        """The distinct last groups of active people."""
        last = F.try_element_at("Groups", F.lit(-1))
        return self.table("members").where("active").select(last["Organization"].alias("Organization"), last["groupid"].alias("groupid")).where("Organization is not null").distinct()

    def ranked(self, group_scores: Mapping[str, float], committee_scores: Mapping[str, float], staff_scores: Mapping[str, float], date: str) -> DataFrame:
        """(UserID, name, score): -1, replaced by the score of the first current group's role (1 if unknown), plus the current
        committee and staff roles' scores, highest first."""

        def of(scores: Mapping[str, float], role, default: float):
            names = F.create_map(*(F.lit(x) for kv in scores.items() for x in (kv[0], float(kv[1])))) if scores else F.create_map(F.lit(""), F.lit(0.0))
            return F.coalesce(names[role], F.lit(default))

        def current(items: str):
            return F.filter(items, lambda i: interval.valid_at(F.lit(date), i["start"], i["end"]))

        def total(items: str, scores: Mapping[str, float]):
            return F.coalesce(F.aggregate(current(items), F.lit(0.0), lambda a, i: a + of(scores, i["role"], 0.0)), F.lit(0.0))

        group = F.get(current("Groups"), F.lit(0))
        base = F.when(group.isNull(), F.lit(-1.0)).otherwise(of(group_scores, group["role"], 1.0))
        score = base + total("Committees", committee_scores) + total("Staff", staff_scores)
        return self.table("members").select("UserID", F.col("Name.full").alias("name"), score.alias("score")).orderBy(F.desc("score"), "UserID")

    def roster(self, committee: str, scores: Mapping[str, float], sentinel: str = interval.OPEN) -> DataFrame:
        """Members of a committee by their last membership in it: (UserID, name, role, score, current)."""
        last = F.try_element_at(F.filter("Committees", lambda c: c["abbr"] == committee), F.lit(-1))
        names = F.create_map(*(F.lit(x) for kv in scores.items() for x in (kv[0], float(kv[1])))) if scores else F.create_map(F.lit(""), F.lit(0.0))
        rows = self.table("members").select("UserID", F.col("Name.full").alias("name"), last.alias("c")).where("c is not null")
        out = rows.select("UserID", "name", F.col("c.role").alias("role"), F.coalesce(names[F.col("c.role")], F.lit(0.0)).alias("score"), (F.col("c.end") == sentinel).alias("current"))
        return out.orderBy(F.desc("current"), F.desc("score"), F.desc("name"))

    def coauthors(self, member: int) -> DataFrame:
        """(name, group, country, n) of those who signed amendments with a person, group and country as of each amendment."""
        rows = self.table("amendments").where(F.array_contains("meps", F.lit(member).cast("long")))
        others = rows.select("date", F.explode(F.filter("meps", lambda m: m != member)).alias("UserID"))
        who = others.join(self.table("members").select("UserID", "Name", "Groups", "Constituencies"), "UserID")
        group = F.coalesce(interval.first_valid(F.col("Groups"), F.col("date"))["groupid"], F.lit("???"))
        country = F.coalesce(interval.first_valid(F.col("Constituencies"), F.col("date"))["country"], F.lit("???"))
        return who.groupBy(F.col("Name.full").alias("name"), group.alias("group"), country.alias("country")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")

    # dossiers, activities

    def titles(self) -> DataFrame:
        return self.table("dossiers").select("procedure.reference", "procedure.title")

    def subject_titles(self) -> DataFrame:
        """(subject, title), of several titles the last by reference."""
        rows = self.table("dossiers").select("procedure.reference", F.explode("procedure.subject").alias("subject", "title"))
        return rows.groupBy("subject").agg(F.max_by("title", "reference").alias("title"))

    def dossiers_by_member(self) -> DataFrame:
        """(k, reference, type) from rapporteurs, shadows and shadow opinions; people must be members, references dossiers."""
        c = self.table("dossiers").select("procedure.reference", F.explode("committees").alias("c"))
        role = F.coalesce("c.type", F.when(F.col("c.responsible"), "Responsible Committee").when(~F.col("c.responsible"), "Committee Opinion"))
        main = c.select(F.explode("c.rapporteur.mepref").alias("k"), "reference", role.alias("type"))
        shadow = c.select(F.explode("c.shadows.mepref").alias("k"), "reference", F.concat(role, F.lit(" Shadow")).alias("type"))
        people = self.table("members").select(F.col("UserID").alias("k"))
        named = main.unionByName(shadow).where("type is not null").join(people, "k", "left_semi")
        acts = self.table("activities").select(F.col("mep_id").alias("k"), F.explode(F.col("acts")["COMPARL-SHADOW"]).alias("a"))
        acts = acts.select("k", F.explode("a.dossiers").alias("reference")).join(self.titles().select("reference"), "reference")
        return named.unionByName(acts.select("k", "reference", F.lit("Committee Opinion Shadow").alias("type")))

    def activities_by_dossier(self) -> DataFrame:
        """(k, type, mep_id, name, act)."""
        acts = self.table("activities").select("mep_id", F.explode("acts").alias("type", "list")).select("mep_id", "type", F.explode("list").alias("act"))
        rows = acts.select("mep_id", "type", "act", F.explode("act.dossiers").alias("k")).where("k is not null")
        names = self.table("members").select(F.col("UserID").alias("mep_id"), F.col("Name.full").alias("name"))
        return rows.join(names, "mep_id").select("k", "type", "mep_id", "name", "act")

    def activities(self, member: int, kind: str | None = None, dossier: str | None = None) -> DataFrame:
        """A person's activities map, of one type, of one dossier; types left empty go."""
        acts = F.col("acts") if kind is None else F.map_filter("acts", lambda k, v: k == kind)
        if dossier is not None:
            acts = F.transform_values(acts, lambda k, v: F.filter(v, lambda a: F.array_contains(a["dossiers"], dossier)))
            acts = F.map_filter(acts, lambda k, v: F.size(v) > 0)
        return self.table("activities").where(F.col("mep_id") == member).select("mep_id", acts.alias("acts"))

    def committees(self, now: str) -> DataFrame:
        """(committee, active, organization, dossiers): bodies of people and of dossiers; what one source lacks is null."""
        m = self.table("members").select(F.explode("Committees").alias("c")).where("c.abbr is not null")
        people = m.groupBy(F.col("c.abbr").alias("committee")).agg(F.bool_or(F.col("c.end") > now).alias("active"), F.min("c.Organization").alias("organization"))
        d = self.table("dossiers").select(F.explode("committees").alias("c")).where("c.type = 'Responsible Committee'").select(F.explode("c.committee").alias("committee"))
        return people.join(d.groupBy("committee").agg(F.count("*").alias("dossiers")), "committee", "full_outer")

    def search(self, query: str) -> DataFrame:
        """(kind, key, label): people by their exact name, else by all terms in it; dossiers by all terms in one field."""
        m = self.table("members")
        exact = F.array_contains(F.transform("Name.aliases", search.normal_name), search.normal_name(F.lit(query)))
        people = search.exact_or_pattern(m, F.coalesce(exact, F.lit(False)), search.any_field([F.col("Name.full")], query))
        p = F.col("procedure")
        fields = [p["title"], p["reference"], F.array_join(F.map_keys(p["subject"]), " "), F.col("celexid")]
        found = self.table("dossiers").where(search.any_field(fields, query))
        return people.select(F.lit("person").alias("kind"), F.col("UserID").cast("string").alias("key"), F.col("Name.full").alias("label")).unionByName(
            found.select(F.lit("dossier").alias("kind"), p["reference"].alias("key"), p["title"].alias("label"))
        )

    # votes

    def ballots(self) -> DataFrame:
        """(voteid, ts, sign, grp, mepid, name): one row a ballot."""
        signs = self.table("votes").select("voteid", "ts", F.explode("votes").alias("sign", "side"))
        groups = signs.select("voteid", "ts", "sign", F.explode("side.groups").alias("grp", "people"))
        return groups.select("voteid", "ts", "sign", "grp", F.explode("people").alias("p")).select("voteid", "ts", "sign", "grp", "p.mepid", "p.name")

    def placed_ballots(self) -> DataFrame:
        """Ballots of known people with the country they stood for that day, ?? if none."""
        rows = self.ballots().where("mepid is not null").join(self.table("members").select(F.col("UserID").alias("mepid"), "Constituencies"), "mepid", "left")
        country = interval.first_valid(F.col("Constituencies"), F.col("ts"))["country"]
        return rows.select("voteid", "ts", "sign", "grp", "mepid", F.coalesce(country, F.lit("??")).alias("country"))

    def vote_matrix(self) -> DataFrame:
        """Cells and marginals of every vote: (voteid, grp, country, plus, minus, zero, total, level)."""
        return matrix.marginals(self.placed_ballots(), "grp", "country", F.col("sign"), ["voteid"])

    def cohesion(self, by: str = "country") -> DataFrame:
        """(entity, voteid, t): (plus - minus) / members of the entity with a mandate that day."""
        mandates = self.table("members").select("UserID", F.explode("Constituencies").alias("c"))
        field = "c.country" if by == "country" else "c.party"
        votes = self.table("votes").select("voteid", F.substring("ts", 1, 10).alias("day")).distinct()
        spans = mandates.select("UserID", F.col(field).alias("entity"), F.left("c.start", F.lit(10)).alias("a"), F.left("c.end", F.lit(10)).alias("z")).where("entity is not null")
        days = votes.select("day").distinct()
        # few entities have mandates at a time: the distinct days meet the spans by range, before votes multiply them
        size = spans.join(F.broadcast(days) if days.count() <= 20_000 else days, F.col("day").between(F.col("a"), F.col("z"))).groupBy("entity", "day").agg(F.count_distinct("UserID").alias("members"))
        placed = self.ballots().where("mepid is not null").withColumn("day", F.left("ts", F.lit(10)))
        m = spans.withColumnRenamed("UserID", "mepid")
        cast = placed.join(m, "mepid").where(F.col("day").between(F.col("a"), F.col("z"))).groupBy("entity", "voteid", "day").agg((F.count_if(F.col("sign") == "+") - F.count_if(F.col("sign") == "-")).alias("d"))
        return cast.join(size, ["entity", "day"]).select("entity", "voteid", (F.col("d") / F.col("members")).alias("t"))

    def similarity(self, by: str = "country") -> DataFrame:
        return similarity.pairwise_cosine(self.cohesion(by), "entity", "voteid", "t").orderBy("similarity", "n", "a", "b")
