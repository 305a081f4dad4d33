"""City names as keys."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes and names of the states of the USA.
STATE_CODES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc"
).split()
STATE_NAMES = (
    "alabama,alaska,arizona,arkansas,california,colorado,connecticut,delaware,florida,georgia,hawaii,idaho,illinois,indiana,iowa,kansas,kentucky,louisiana,maine,"
    "maryland,massachusetts,michigan,minnesota,mississippi,missouri,montana,nebraska,nevada,new hampshire,new jersey,new mexico,new york,north carolina,"
    "north dakota,ohio,oklahoma,oregon,pennsylvania,rhode island,south carolina,south dakota,tennessee,texas,utah,vermont,virginia,washington,west virginia,"
    "wisconsin,wyoming"
).split(",")


def spaceless(name: Column) -> Column:
    """Lower case without spaces."""
    return F.replace(F.lower(name), F.lit(" "), F.lit(""))


def stateless(name: Column) -> Column:
    """Lower case without commas and spaces; a state's code at the end goes if the name had a comma and is long enough."""
    plain = F.regexp_replace(F.lower(name), "[, ]", "")
    has_code = name.contains(",") & (F.length(plain) > 4) & F.substring(plain, -2, 2).isin(STATE_CODES)
    return F.when(has_code, F.left(plain, F.length(plain) - 2)).otherwise(plain)


#: Codes and names without spaces.
_ADMIN = frozenset(STATE_CODES) | frozenset(x.replace(" ", "") for x in STATE_NAMES)


def canonical_name(name: str | None) -> str:
    """Letters and digits without case and accents; what follows a comma goes, else a state's name or code that the last word,
    or the last two of several, make. Words are what ASCII letters and digits make, whatever stands between. Empty for
    null."""
    plain = unicodedata.normalize("NFKD", (name or "").strip().casefold())
    plain = "".join(c for c in plain if not unicodedata.combining(c))
    kept, comma, _ = plain.partition(",")
    words = [] if comma else re.findall(r"[a-z0-9]+", plain)
    if len(words) > 1:
        ends = [n for n in (1, 2) if n < len(words) and "".join(words[-n:]) in _ADMIN]
        kept = "".join(words[: -ends[0]] if ends else words)
    return "".join(c for c in kept if c.isalnum())


def normalise_names(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds canonical_name of a column. Only its distinct values go through Python; the join back is on the name."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def canonical(names):
        return names.map(lambda x: canonical_name(x if isinstance(x, str) else None))

    labels = df.select(F.col(name).alias("__name")).distinct()
    aliases = labels.withColumn(out, canonical("__name"))
    return df.join(aliases, F.col(name).eqNullSafe(F.col("__name")), "left").drop("__name")


def panorama_id(file_name: Column) -> Column:
    """The id that an image's name begins with."""
    return F.substring(file_name, 1, 22)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
