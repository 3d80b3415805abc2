"""Published sanctions lists as one table of entries.

The files are XML in three dialects and CSV. They are read by Spark's own readers, so they can be in any store; names,
births and documents stay nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.dates import BIRTH, parse_loose_birth

NAME = "struct<full:string,type:string,strong:boolean,script:string>"
DOCUMENT = "struct<kind:string,number:string,country:string,chain:string>"
ENTRY = f"list string, ref_id string, kind string, names array<{NAME}>, births array<{BIRTH}>, nationalities array<string>, citizenships array<string>, documents array<{DOCUMENT}>, addresses array<string>, programs array<string>, remarks string"


class ListRefused(ValueError):
    """A file that is empty, truncated or of another layout."""


def _clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.when(_clean(p) != "", _clean(p)) for p in parts))


def _array(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _texts(c: Column) -> Column:
    return F.filter(F.transform(_array(c, "string"), _clean), lambda v: v != "")


def _distinct(c: Column) -> Column:
    """Texts that differ in more than case, each as it comes first."""
    low = F.transform(c, F.lower)
    return F.filter(c, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").option("ignoreNamespace", True).schema(schema).load(path)


def _name(full: Column, kind: Column, strong: Column, script: Column | None = None) -> Column:
    return F.struct(full.alias("full"), kind.alias("type"), strong.alias("strong"), (script if script is not None else F.lit("")).alias("script"))


def _document(kind: Column, number: Column, country: Column, chain: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), number.alias("number"), country.alias("country"), (chain if chain is not None else F.lit("")).alias("chain"))


def _entries(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    empty = {"births": BIRTH, "nationalities": "string", "citizenships": "string", "documents": DOCUMENT, "addresses": "string", "programs": "string"}
    for name, kind in empty.items():
        columns.setdefault(name, F.array().cast(f"array<{kind}>"))
    columns["names"] = F.filter(columns["names"], lambda n: n["full"] != "")
    out = df.select(F.lit(source).alias("list"), *(columns[c].alias(c) for c in ("ref_id", "kind", "names", "births", "nationalities", "citizenships", "documents", "addresses", "programs", "remarks")))
    return out


def _refuse_empty(entries: DataFrame, source: str) -> DataFrame:
    if not entries.limit(1).count():
        raise ListRefused(f"{source}: no records")
    return entries


def _first_last(births: Column) -> Column:
    """Main entries first, each side in its order."""
    return F.concat(F.filter(births, lambda b: b["main"]), F.filter(births, lambda b: ~b["main"]))


def ofac(spark: SparkSession, path: str) -> DataFrame:
    """The SDN file. Refused if it has another number of records than it declares."""
    schema = """uid string, firstName string, lastName string, sdnType string, remarks string, programList struct<program:array<string>>,
      akaList struct<aka:array<struct<type:string,category:string,firstName:string,lastName:string>>>,
      idList struct<id:array<struct<idType:string,idNumber:string,idCountry:string>>>,
      dateOfBirthList struct<dateOfBirthItem:array<struct<dateOfBirth:string,mainEntry:string>>>,
      nationalityList struct<nationality:array<struct<country:string>>>, citizenshipList struct<citizenship:array<struct<country:string>>>,
      addressList struct<address:array<struct<address1:string,address2:string,address3:string,city:string,stateOrProvince:string,postalCode:string,country:string>>>"""
    df = _xml(spark, path, "sdnEntry", schema)
    declared = _xml(spark, path, "publshInformation", "Record_Count int").head()
    if declared and declared[0] and declared[0] != df.count():
        raise ListRefused(f"OFAC: {df.count()} records, {declared[0]} declared")
    aka = lambda a: _name(_joined(a["firstName"], a["lastName"]), F.when(F.lower(_clean(a["type"])) == "f.k.a.", "formerly").when(F.lower(_clean(a["type"])) == "n.k.a.", "now").otherwise("also"), F.lower(_clean(a["category"])) != "weak")
    akas = F.transform(_array(F.col("akaList.aka"), "struct<type:string,category:string,firstName:string,lastName:string>"), aka)
    prefix = "Digital Currency Address - "

    def paper(d: Column) -> Column:
        t = _clean(d["idType"])
        kind = F.when(t.startswith(prefix), "address").when(F.lower(t).contains("passport"), "passport").when(F.lower(t).contains("national id"), "national").otherwise("other")
        return _document(kind, _clean(d["idNumber"]), _clean(d["idCountry"]), F.when(t.startswith(prefix), F.trim(F.substr(t, F.lit(len(prefix) + 1)))).otherwise(""))

    papers = F.filter(F.transform(_array(F.col("idList.id"), "struct<idType:string,idNumber:string,idCountry:string>"), paper), lambda d: d["number"] != "")
    kind = F.lower(_clean(F.col("sdnType")))
    kind = F.when(kind.isin("individual", "vessel", "aircraft"), kind).otherwise("entity")
    place = lambda a: _joined(*(a[c] for c in ("address1", "address2", "address3", "city", "stateOrProvince", "postalCode", "country")))
    births = df.select("uid", F.posexplode("dateOfBirthList.dateOfBirthItem").alias("i", "b")).select("uid", "i", (F.lower(_clean(F.col("b.mainEntry"))) == "true").alias("main"), parse_loose_birth(F.coalesce("b.dateOfBirth", F.lit(""))).alias("p")).where("p.from_s is not null")
    births = births.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct((~F.col("main")).alias("later"), "i", "p"))).alias("b")).select(F.col("uid").alias("b_uid"), F.col("b.p").alias("births"))
    df = df.join(births, df["uid"] == F.col("b_uid"), "left")
    return _entries(
        df, "ofac", ref_id=F.col("uid"), kind=kind, remarks=_clean(F.col("remarks")), programs=_texts(F.col("programList.program")),
        names=F.concat(F.array(_name(_joined(F.col("firstName"), F.col("lastName")), F.lit("primary"), F.lit(True))), akas), births=_array(F.col("births"), BIRTH),
        nationalities=_texts(F.col("nationalityList.nationality.country")), citizenships=_texts(F.col("citizenshipList.citizenship.country")), documents=papers,
        addresses=F.filter(F.transform(F.coalesce("addressList.address", F.array().cast("array<struct<address1:string,address2:string,address3:string,city:string,stateOrProvince:string,postalCode:string,country:string>>")), place), lambda v: v != ""),
    )


def un(spark: SparkSession, path: str) -> DataFrame:
    """The consolidated list: individuals, then entities. Refused if it has no records."""
    alias, place = "struct<QUALITY:string,ALIAS_NAME:string>", "struct<STREET:string,CITY:string,STATE_PROVINCE:string,COUNTRY:string>"
    born, paper = "struct<TYPE_OF_DATE:string,DATE:string,YEAR:string,FROM_YEAR:string,TO_YEAR:string>", "struct<TYPE_OF_DOCUMENT:string,NUMBER:string,ISSUING_COUNTRY:string>"
    schema = f"""DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, NAME_ORIGINAL_SCRIPT string, UN_LIST_TYPE string,
      REFERENCE_NUMBER string, COMMENTS1 string, NATIONALITY struct<VALUE:array<string>>, INDIVIDUAL_ALIAS array<{alias}>, ENTITY_ALIAS array<{alias}>,
      INDIVIDUAL_DATE_OF_BIRTH array<{born}>, INDIVIDUAL_DOCUMENT array<{paper}>, INDIVIDUAL_ADDRESS array<{place}>, ENTITY_ADDRESS array<{place}>"""

    def birth(b: Column) -> Column:
        kind, d, y, low, high = F.upper(_clean(b["TYPE_OF_DATE"])), _clean(b["DATE"]), _clean(b["YEAR"]), _clean(b["FROM_YEAR"]), _clean(b["TO_YEAR"])
        between = (kind == "BETWEEN") & (low != "") & (high != "")
        start = F.when(d != "", d).when(between, low).when(y != "", y)
        return F.struct(start.alias("from_s"), F.when(d != "", d).when(between, high).when(y != "", y).alias("to_s"), (kind == "APPROXIMATELY").alias("circa"))

    def one(tag: str, kind: str) -> DataFrame:
        df = _xml(spark, path, tag, schema)
        aliases = F.transform(F.concat(_array(F.col("INDIVIDUAL_ALIAS"), alias), _array(F.col("ENTITY_ALIAS"), alias)), lambda a: _name(_clean(a["ALIAS_NAME"]), F.when(F.lower(_clean(a["QUALITY"])) == "f.k.a.", "formerly").otherwise("also"), F.lower(_clean(a["QUALITY"])) != "low"))
        first = _name(_joined(*(F.col(c) for c in ("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME"))), F.lit("primary"), F.lit(True), _clean(F.col("NAME_ORIGINAL_SCRIPT")))
        papers = F.transform(_array(F.col("INDIVIDUAL_DOCUMENT"), paper), lambda d: _document(F.when(F.lower(_clean(d["TYPE_OF_DOCUMENT"])).contains("passport"), "passport").when(F.lower(_clean(d["TYPE_OF_DOCUMENT"])).contains("national"), "national").otherwise("other"), _clean(d["NUMBER"]), _clean(d["ISSUING_COUNTRY"])))
        where = F.transform(F.concat(_array(F.col("INDIVIDUAL_ADDRESS"), place), _array(F.col("ENTITY_ADDRESS"), place)), lambda a: _joined(a["STREET"], a["CITY"], a["STATE_PROVINCE"], a["COUNTRY"]))
        ref = F.when(_clean(F.col("REFERENCE_NUMBER")) != "", _clean(F.col("REFERENCE_NUMBER"))).otherwise(_clean(F.col("DATAID")))
        return _entries(
            df, "un", ref_id=ref, kind=F.lit(kind), names=F.concat(F.array(first), aliases), births=F.filter(F.transform(_array(F.col("INDIVIDUAL_DATE_OF_BIRTH"), born), birth), lambda b: b["from_s"].isNotNull()),
            nationalities=_texts(F.col("NATIONALITY.VALUE")), documents=F.filter(papers, lambda d: d["number"] != ""), addresses=F.filter(where, lambda v: v != ""), programs=_texts(F.array("UN_LIST_TYPE")), remarks=_clean(F.col("COMMENTS1")),
        )

    return _refuse_empty(one("INDIVIDUAL", "individual").unionByName(one("ENTITY", "entity")), "UN")


def eu(spark: SparkSession, path: str) -> DataFrame:
    """The financial sanctions file, whose values are attributes. Births of other calendars are left out. Refused if it has no records."""
    born = "struct<_birthdate:string,_year:string,_monthOfYear:string,_dayOfMonth:string,_yearRangeFrom:string,_yearRangeTo:string,_circa:string,_calendarType:string>"
    alias = "struct<_wholeName:string,_firstName:string,_middleName:string,_lastName:string,_strong:string>"
    paper, home, place = "struct<_number:string,_latinNumber:string,_identificationTypeCode:string,_identificationTypeDescription:string,_countryIso2Code:string>", "struct<_countryIso2Code:string,_countryDescription:string>", "struct<_street:string,_city:string,_zipCode:string,_region:string,_countryDescription:string>"
    schema = f"_euReferenceNumber string, _logicalId string, remark array<string>, subjectType struct<_classificationCode:string>, regulation array<struct<_programme:string>>, nameAlias array<{alias}>, birthdate array<{born}>, citizenship array<{home}>, identification array<{paper}>, address array<{place}>"
    df = _xml(spark, path, "sanctionEntity", schema)

    def name(n: Column, i: Column) -> Column:
        full = F.when(_clean(n["_wholeName"]) != "", _clean(n["_wholeName"])).otherwise(_joined(n["_firstName"], n["_middleName"], n["_lastName"]))
        return _name(full, F.when(i == 0, "primary").otherwise("also"), F.lower(_clean(n["_strong"])) != "false")

    def birth(b: Column) -> Column:
        two = lambda c: F.lpad(_clean(c), 2, "0")
        y, m, d = _clean(b["_year"]), _clean(b["_monthOfYear"]), _clean(b["_dayOfMonth"])
        parts = F.when(y == "", None).when(m == "", y).when(d == "", F.concat_ws("-", y, two(m))).otherwise(F.concat_ws("-", y, two(m), two(d)))
        day, low, high = _clean(b["_birthdate"]), _clean(b["_yearRangeFrom"]), _clean(b["_yearRangeTo"])
        spread = (low != "") & (high != "")
        return F.struct(F.when(day != "", day).when(spread, low).otherwise(parts).alias("from_s"), F.when(day != "", day).when(spread, high).otherwise(parts).alias("to_s"), (F.lower(_clean(b["_circa"])) == "true").alias("circa"))

    births = F.filter(_array(F.col("birthdate"), born), lambda b: F.upper(_clean(b["_calendarType"])).isin("", "GREGORIAN"))
    said = lambda d: F.lower(F.concat_ws(" ", d["_identificationTypeDescription"], d["_identificationTypeCode"]))
    papers = F.transform(_array(F.col("identification"), paper), lambda d: _document(F.when(said(d).contains("passport"), "passport").when(said(d).contains("id"), "national").otherwise("other"), F.when(_clean(d["_number"]) != "", _clean(d["_number"])).otherwise(_clean(d["_latinNumber"])), _clean(d["_countryIso2Code"])))
    return _refuse_empty(_entries(
        df, "eu", ref_id=F.when(_clean(F.col("_euReferenceNumber")) != "", _clean(F.col("_euReferenceNumber"))).otherwise(_clean(F.col("_logicalId"))),
        kind=F.when(F.upper(_clean(F.col("subjectType._classificationCode"))) == "P", "individual").otherwise("entity"), names=F.transform(_array(F.col("nameAlias"), alias), name),
        births=F.filter(F.transform(births, birth), lambda b: b["from_s"].isNotNull()), citizenships=F.filter(F.transform(_array(F.col("citizenship"), home), lambda c: F.when(_clean(c["_countryDescription"]) != "", _clean(c["_countryDescription"])).otherwise(_clean(c["_countryIso2Code"]))), lambda v: v != ""),
        documents=F.filter(papers, lambda d: d["number"] != ""), addresses=F.filter(F.transform(_array(F.col("address"), place), lambda a: _joined(a["_street"], a["_city"], a["_zipCode"], a["_region"], a["_countryDescription"])), lambda v: v != ""),
        programs=_texts(F.col("regulation._programme")), remarks=F.trim(F.array_join(_array(F.col("remark"), "string"), "; ")),
    ), "EU")


def ofsi(spark: SparkSession, path: str) -> DataFrame:
    """The UK list: rows of one group are one entry, and a preamble of one or two columns may come before the header.

    Refused without its columns or without records. Where no row is marked primary, the first name becomes it.
    """
    lines = spark.read.text(path).limit(2).collect()
    if not lines:
        raise ListRefused("OFSI: an empty file")
    skip = 1 if lines[0][0].lstrip("﻿").count(",") <= 1 else 0
    names = [h.strip().strip('"').lstrip("﻿").strip() for h in lines[min(skip, len(lines) - 1)][0].split(",")]
    for want in ("Name 1", "Name 6", "Group Type", "Group ID", "Regime"):
        if want not in names:
            raise ListRefused(f"OFSI: no column {want}")
    from pyspark.sql.types import StringType, StructField, StructType

    df = spark.read.schema(StructType([StructField(n, StringType()) for n in names])).csv(path, multiLine=True, escape='"', mode="PERMISSIVE").withColumn("_i", F.monotonically_increasing_id())
    df = df.where((F.trim("Group ID") != "") & (F.trim("Group ID") != "Group ID") & (F.col("Name 6").isNotNull() | F.col("Group Type").isNotNull()))
    col = lambda n: _clean(F.col(f"`{n}`")) if n in names else F.lit("")
    y, m, d = (F.coalesce(F.regexp_extract(col("DOB"), r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i).try_cast("int"), F.lit(0)) for i in (3, 2, 1))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    iso = F.when(y == 0, None).when(m == 0, F.lpad(y.cast("string"), 4, "0")).when(d == 0, F.concat_ws("-", y, two(m))).otherwise(F.concat_ws("-", y, two(m), two(d)))
    kind = F.lower(col("Alias Type"))
    name = _name(_joined(*(col(f"Name {i}") for i in range(1, 7))), F.when(kind == "primary name", "primary").when(kind == "fka", "formerly").otherwise("also"), F.lower(col("Alias Quality")) != "low quality", col("Name Non-Latin Script"))
    home = _joined(*(col(f"Address {i}") for i in range(1, 7)), col("Post/Zip Code"), col("Country"))
    rows = df.select(col("Group ID").alias("g"), "_i", col("Group Type").alias("gt"), col("Regime").alias("regime"), name.alias("name"), iso.alias("iso"), col("Nationality").alias("nation"), col("Passport Number").alias("passport"), col("National Identification Number").alias("national"), home.alias("home"), col("Other Information").alias("other"))
    per = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("_i", "gt", "regime", "name", "iso", "nation", "passport", "national", "home", "other"))).alias("r"))
    _refuse_empty(per, "OFSI")
    got = F.filter(F.col("r.name"), lambda n: n["full"] != "")
    promoted = F.when(F.exists(got, lambda n: n["type"] == "primary"), got).otherwise(F.transform(got, lambda n, i: F.when(i == 0, n.withField("type", F.lit("primary"))).otherwise(n)))
    papers = F.flatten(F.transform("r", lambda x: F.filter(F.array(_document(F.lit("passport"), x["passport"], F.lit("")), _document(F.lit("national"), x["national"], F.lit(""))), lambda p: p["number"] != "")))
    births = F.transform(F.array_distinct(F.filter(F.col("r.iso"), lambda v: v.isNotNull())), lambda v: F.struct(v.alias("from_s"), v.alias("to_s"), F.lit(False).alias("circa")))
    group = F.lower(F.col("r")[0]["gt"])
    return _entries(
        per, "ofsi", ref_id=F.col("g"), kind=F.when(group == "individual", "individual").when(group == "ship", "vessel").otherwise("entity"), names=promoted, births=births,
        nationalities=_distinct(_texts(F.col("r.nation"))), documents=papers, addresses=_distinct(_texts(F.col("r.home"))), programs=_texts(F.array(F.col("r")[0]["regime"])), remarks=F.coalesce(F.get(_texts(F.col("r.other")), F.lit(0)), F.lit("")),
    )
