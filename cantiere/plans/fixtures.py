"""Input files in the published layouts, written by Spark tasks from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantiere.functions import rules as R
from cantiere.functions.values import zero_pad
from cantiere.plans import bindings as B
from cantiere.session import qualified

DESCRIPTIONS = {
    "BUILDING": "Ristrutturazione scuola media", "MACHINERY": "nuova realizzazione capannone",
    "AUTOMOBILE": "messa in sicurezza strada", "HOUSEHOLD": "opere varie", "FURNITURE": "voucher lavori pubblici",
}


def write_zip_csv(df: DataFrame, folder: str, delimiter: str = ";", members: int = 2, note: str = "") -> None:
    """One zip archive per task with ``members`` csv files; an archive appears under its name when complete.

    ``note`` adds a small member ``note.csv`` with that text.
    """
    names = df.columns
    folder = qualified(df.sparkSession, folder)

    def write(batches):
        import csv
        import io
        import zipfile

        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        local = folder.startswith("file:")
        filesystem, plain = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(folder)
        ctx = TaskContext.get()
        filesystem.create_dir(plain, recursive=True)
        target = f"{plain}/part-{ctx.partitionId():05d}.zip"
        draft = f"{plain}/.draft-{ctx.partitionId():05d}-{ctx.taskAttemptId()}"
        rows = 0
        pending = iter(batches)
        first = next(pending, None)
        if first is not None:
            with filesystem.open_output_stream(draft) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                for m in range(members):
                    with z.open(f"data_{m}.csv", "w") as out:
                        text = io.TextIOWrapper(out, encoding="utf-8-sig", newline="")
                        writer = csv.writer(text, delimiter=delimiter)
                        writer.writerow(names)
                        # the last member takes the remaining batches
                        while first is not None:
                            writer.writerows(first.astype(object).where(first.notna(), "").itertuples(index=False))
                            rows += len(first)
                            first = next(pending, None)
                            if m < members - 1:
                                break
                        text.flush()
                if note:
                    z.writestr("note.csv", note)
            filesystem.move(draft, target)
        yield pd.DataFrame({"rows": [rows]})

    df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).mapInPandas(write, "rows long").agg(F.sum("rows")).first()


def positional_register(spark: SparkSession, sf: str) -> DataFrame:
    """Register rows with unnamed columns ``_c0`` .. ``_c79``."""
    p = B.projects(spark, sf)
    text = R.lookup(F.col("category"), DESCRIPTIONS)
    values = {
        0: F.when(F.col("status") == "CHIUSO", F.concat(F.lit("CUP "), project_code())).otherwise(project_code()),
        1: F.concat_ws("*", "title", "municipality", text), 2: F.col("year"),
        3: F.when(F.col("status").isNull(), "ITALIA").otherwise(F.concat(F.lit("Progetto "), F.lower("status"))),
        4: F.concat(F.translate(F.format_number("value_eur", 2), ",.", ".,"), F.lit(" €")),
        11: F.when(F.col("region") == "ASIA", "N.D.").otherwise(F.col("region")), 13: F.lit("XX"),
        14: F.when(F.col("region") == "AFRICA", "********").otherwise(F.col("province")), 16: F.col("municipality"),
        17: F.concat(F.lit("  "), F.replace(F.col("client"), F.lit(" "), F.lit("   "))),
        19: F.when(F.col("year") > 1998, F.lit("Roma")), 20: F.when(F.col("year") > 1998, F.lit("Via")), 21: F.lit("-"),
        33: F.when(F.col("category") == "HOUSEHOLD", F.when(F.col("region") == "EUROPE", "LAVORI PUBBLICI")).otherwise("OPERE"),
        41: F.col("title"), 48: F.when(F.col("category") == "MACHINERY", text), 52: F.when(F.col("category") == "BUILDING", F.col("title")),
        57: F.when(F.col("region") == "EUROPE", F.lit("x")).otherwise("Statale"), 60: F.lit("PRIVATA"),
    }
    blank = F.lit(None).cast("string")
    return p.select(*[values.get(i, blank).cast("string").alias(f"_c{i}") for i in range(80)])


def project_code():
    """15-character project code with the decision year in characters 5-6."""
    return F.concat(F.lit("C"), F.lpad(F.substring("province", 8, 2), 2, "0"), F.lit("E"), F.substring(F.col("year").cast("string"), 3, 2),
                    zero_pad(F.substring("cup", 2, 40).cast("bigint"), 9))


def named_register(spark: SparkSession, sf: str) -> DataFrame:
    """Register rows with published column names, including tender and contact columns."""
    p = B.projects(spark, sf)
    chiuso = F.col("status") == "CHIUSO"
    return p.select(
        F.col("cup").alias("CODICE CUP"), F.col("title").alias("Titolo Progetto"),
        F.concat(R.lookup(F.col("category"), DESCRIPTIONS), F.lit(" e lavori")).alias("Descrizione_Intervento"),
        F.col("category").alias("CATEGORIA"), F.concat(F.lit("stato "), "status").alias("Stato Progetto"), F.col("year").alias("Anno Decisione"),
        F.col("region").alias("Den Regione"), F.col("province").alias("DEN_PROVINCIA"), F.col("municipality").alias("Comune"),
        F.col("client").alias("Soggetto Titolare"), F.translate(F.format_number("value_eur", 2), ",.", ".,").alias("Costo Previsto"),
        F.when(chiuso, F.concat(F.lit("Z"), F.substring("cup", 2, 9))).otherwise("NO").alias("Smart CIG"),
        F.concat(F.lit("Impresa "), "client").alias("Ditta aggiudicataria"), F.lit("01234").alias("P.IVA aggiudicatario"),
        F.when(F.col("year") > 1998, F.lit("Mario Rossi")).otherwise("27.5").alias("RUP"), F.lit("rup@example.org").alias("email rup"),
    )
