"""What belongs to what: votes to amendments and procedures, shadow rapporteurs to committees, agenda items to meetings, ballots to members."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.operators import interval

# How titles name documents, procedures, dates and amendments; the act that makes a shadow rapporteur; the committees
# that have none; the documents of plenary that a procedure can begin with; the one renumbered member.
DOCUMENT = r"((?:[AB]|RC-B)[6789]\s*-\s*[0-9]{3,4}/[0-9]{4})"
PROCEDURE = r"((?:20|19)[0-9]{2}/[0-9]{4}[A-Z]?\((?:ACI|APP|AVC|BUD|CNS|COD|COS|DCE|DEA|DEC|IMM|INI|INL|INS|NLE|REG|RPS|RSO|RSP|SYN)\))"
DATE, AMENDMENTS, SEPARATORS = r" \d{2}/\d{2}/\d{4}.+", r"Am (\d+(?:[sS=, ]{1,2}\d+)*)", "[sS=, ]+"
SHADOW = "COMPARL-SHADOW"
LEADING = ("Responsible Committee", "Former Responsible Committee")
MOTIONS = ("Motion for a resolution", "Joint motion for resolution")
MOTION = r"^(?:[AB]|RC-B)[3456789]-\d{4}/ ?\d{1,4}"
RENUMBERED = (6840, 197443)

NUMBER = r"[A-Z][0-9]-[0-9]{3,4}/[0-9]{4}"  # what every document's reference holds


def amendment_votes(amendments: DataFrame, votes: DataFrame, pos: str = "pos") -> DataFrame:
    """(id, vote_ids) for amendments (id, aref, seq) and votes (voteid, title, pos): the votes, in order, whose title holds the document's
    reference and, after its date is cut off, lists the amendment's number. Both are looked for by a join on the number in the reference and
    on the amendment's; an amendment without a vote has an empty list."""
    listed = F.regexp_extract(F.regexp_replace("title", DATE, ""), AMENDMENTS, 1)
    numbers = F.array_distinct(F.regexp_extract_all("title", F.lit(f"({NUMBER})"), F.lit(1)))
    v = votes.select(F.col(pos).alias("__pos"), "voteid", "title", F.explode(F.array_distinct(F.split(listed, SEPARATORS))).alias("__seq"), numbers.alias("__numbers"))
    v = v.select("__pos", "voteid", "title", "__seq", F.explode("__numbers").alias("__number"))
    a = amendments.select("id", "aref", F.col("seq").cast("string").alias("__seq"), F.regexp_extract("aref", NUMBER, 0).alias("__number"))
    hits = a.where("__number <> '' and __seq <> ''").join(v, ["__number", "__seq"]).where(F.contains("title", "aref"))
    found = hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("__pos", "voteid"))).alias("__found"))
    ids = F.transform(F.coalesce("__found", F.array().cast(found.schema["__found"].dataType)), lambda x: x.voteid)
    return amendments.select("id").join(found, "id", "left").select("id", ids.alias("vote_ids"))


def vote_procedures(votes: DataFrame, by_document: DataFrame, procedures: DataFrame, documents: Mapping[str, str], phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """(voteid, doc, epref) of votes (voteid, title). A title that names a document belongs to that document's procedures (by_document: doc,
    reference), else to the one that `documents` says; any other title to the procedure that it names, if there is one (procedures: reference),
    else to that of the first of `phrases` (text, reference) in it. Null: none."""
    doc = F.regexp_replace(F.regexp_extract("title", DOCUMENT, 1), " ", "")
    rows = votes.select("voteid", "title", F.when(doc != "", doc).alias("doc"), F.regexp_extract("title", PROCEDURE, 1).alias("__named"))
    of_document = by_document.groupBy("doc").agg(F.array_sort(F.collect_set("reference")).alias("__of"))
    known = procedures.select(F.col("reference").alias("__named")).distinct().withColumn("__known", F.lit(True))
    rows = rows.join(of_document, "doc", "left").join(known, "__named", "left")
    fixed = F.lit(None).cast("string")
    for text, reference in reversed(phrases):
        fixed = F.when(F.contains("title", F.lit(text)), F.lit(reference)).otherwise(fixed)
    of_fixed = F.try_element_at(F.create_map(*(F.lit(x) for kv in documents.items() for x in kv)), F.col("doc")) if documents else F.lit(None).cast("string")
    other = F.when(F.col("doc").isNotNull(), of_fixed).otherwise(F.when(F.col("__known"), F.col("__named")).otherwise(fixed))
    return rows.select("voteid", "doc", F.coalesce("__of", F.when(other.isNotNull(), F.array(other))).alias("epref"))


def with_shadows(dossiers: DataFrame, acts: DataFrame, members: DataFrame, now: str, pos: str = "pos") -> DataFrame:
    """dossiers (procedure, committees, ..) whose committees, but for the (formerly) responsible ones, have the shadow rapporteurs that
    activities name, after those they have. acts: (reference, kind, UserID, name, date, committee array, pos). Each group that the member
    (UserID, Groups) was in on the day is one entry. Of entries for one committee the last counts."""
    places = dossiers.select(F.col("procedure.reference").alias("__ref"), F.posexplode("committees").alias("__at", "c"))
    eligible = F.coalesce(~F.col("c.type").isin(*LEADING), F.col("c.responsible") == F.lit(False), F.lit(False))
    places = places.where(eligible).select("__ref", "__at", F.explode("c.committee").alias("__code")).groupBy("__ref", "__code").agg(F.max("__at").alias("__at"))
    named = acts.where(F.col("kind") == SHADOW).select(F.col("reference").alias("__ref"), "UserID", "name", "date", F.col(pos).alias("__pos"), F.posexplode("committee").alias("__nth", "__code"))
    groups = members.select("UserID", F.posexplode("Groups").alias("__g", "g"))
    met = named.join(places, ["__ref", "__code"]).join(groups, "UserID")
    met = met.where((F.col("g.start") <= F.col("date")) & (F.col("date") <= interval.normal_end(F.col("g.end"), F.lit(now))))
    entry = F.struct("name", F.col("UserID").cast("long").alias("mepref"), F.col("g.Organization").alias("group"), F.col("g.groupid").alias("abbr"))
    ordered = F.array_sort(F.collect_list(F.struct("__pos", "__nth", "__g", entry.alias("entry"))))
    each = met.groupBy("__ref", "__at").agg(F.transform(ordered, lambda x: x.entry).alias("entries"))
    lists = each.groupBy("__ref").agg(F.map_from_entries(F.collect_list(F.struct("__at", "entries"))).alias("__more"))

    def merged(c: Column, i: Column) -> Column:
        more = F.try_element_at("__more", i)
        return F.when(more.isNull(), c).otherwise(c.withField("shadows", F.concat(F.coalesce(c["shadows"], F.array().cast(kind)), more.cast(kind))))

    kind = dossiers.schema["committees"].dataType.elementType["shadows"].dataType
    rows = dossiers.join(lists, F.col("procedure.reference") == F.col("__ref"), "left")
    return rows.withColumn("committees", F.when(F.col("__more").isNull(), F.col("committees")).otherwise(F.transform("committees", merged))).select(*dossiers.columns)


def meetings(items: DataFrame, pos: str = "pos") -> DataFrame:
    """(id, committee, src, time, city, room, type, items) of flat agenda items. Items with neither a time nor a date are left out; without a
    docid the meeting is named by committee and day. A meeting has what its first item says of it, and its items in order; only
    items of a procedure (epdoc) carry more than a title."""
    date = F.coalesce("date", F.col("time.date"))
    made = F.concat("committee", F.lit("("), F.left(date, F.lit(4)), F.lit(")"), F.substring(date, 6, 2), F.substring(date, 9, 2), F.lit("_XX"))
    when = F.coalesce("time", F.struct(F.col("date").alias("date"), F.coalesce("end", F.lit("")).alias("end")))
    people = F.flatten(F.transform(F.map_entries("actor"), lambda e: F.transform(F.filter(e.value, lambda a: a["name"].isNotNull()), lambda a: F.struct(a["name"].alias("name"), e.key.alias("type"), a["mepref"].alias("mepref")))))
    whole = F.col("epdoc").isNotNull()
    more = [F.when(whole, F.col(f)).alias(f) for f in ("comdossier", "epdoc", "docref", "tabling_deadline", "procedure", "otherdoc", "comdoc", "reading")]
    entry = F.struct("title", *more, F.when(whole & (F.size(people) > 0), people).alias("actors"))
    blank = (F.coalesce(c, F.lit("")).alias(c) for c in ("city", "room", "type"))
    rows = items.where("time is not null or date is not null").select(
        F.coalesce("docid", made).alias("id"), F.col(pos).alias("__pos"), F.struct("committee", "src", when.alias("time"), *blank).alias("head"), entry.alias("entry")
    )
    found = rows.groupBy("id").agg(F.min_by("head", "__pos").alias("head"), F.array_sort(F.collect_list(F.struct("__pos", "entry")), lambda a, b: F.when(a["__pos"] < b["__pos"], -1).when(a["__pos"] > b["__pos"], 1).otherwise(0)).alias("all"))
    return found.select("id", "head.*", F.transform("all", lambda x: x.entry).alias("items"))


def motions(dossiers: DataFrame, years: Sequence[int | str] | None = None) -> DataFrame:
    """(reference, url, date) of the plenary's motions among dossiers' documents, of given years (numbers or texts) only."""
    docs = dossiers.select("procedure.reference", F.explode("docs").alias("d")).where(F.col("d.type").isin(*MOTIONS))
    out = docs.select("reference", F.col("d.date").alias("date"), F.explode("d.docs").alias("x")).where(F.col("x.title").rlike(MOTION) & F.col("x.url").isNotNull())
    if years is not None:
        out = out.where(F.left("date", F.lit(4)).isin(*(str(y) for y in years)))
    return out.select("reference", F.col("x.url").alias("url"), "date")


def ballot_members(ballots: DataFrame, resolved: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ballots (ts, grp, mepid, name, obscure_id, ..) with the member's number where it is given or the name tells it; only the others keep
    name and obscure_id. resolved: (probe, member) of probes (probe, name, date, group, abbr), each name, day and group asked for once."""
    old, new = RENUMBERED
    given = F.when(F.col("mepid") == old, F.lit(new).cast("long")).otherwise(F.col("mepid"))
    rows = ballots.withColumn("mepid", given).withColumn("probe", F.when(given.isNull(), F.to_json(F.struct("name", "ts", "grp"))))
    asked = rows.where("probe is not null").select("probe", "name", F.col("ts").alias("date"), F.lit(None).cast("string").alias("group"), F.col("grp").alias("abbr")).distinct()
    rows = rows.join(resolved(asked).where("member is not null"), "probe", "left").withColumn("mepid", F.coalesce("mepid", F.col("member").cast("long")))
    unknown = {c: F.when(F.col("mepid").isNull(), F.col(c)).alias(c) for c in ("name", "obscure_id")}
    return rows.select(*(unknown.get(c, F.col(c)) for c in ballots.columns))
