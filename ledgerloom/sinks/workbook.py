"""The workbook of a statement: transactions and summary sheets, written by tasks as one file each."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column headings and widths, number and date formats, colours of a doubtful confidence
# and of the verdict.
HEADINGS = (("#", 6), ("Date", 13), ("Value Date", 13), ("Narration", 58), ("Ref No.", 16), ("Debit", 15), ("Credit", 15), ("Balance", 16), ("Confidence", 12), ("Issues", 44))
MONEY_FORMAT, DATE_FORMAT = "#,##,##0.00", "dd/mm/yyyy"
DOUBTFUL, SOUND, UNSOUND = "FFB45309", "FF15803D", "FFB91C1C"
TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
FONTS = "<font/><font><b/></font>" + "".join(f'<font><b/><color rgb="{c}"/></font>' for c in (DOUBTFUL, SOUND, UNSOUND)) + '<font><b/><sz val="13"/></font>'
STYLES = f"""<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="2"><numFmt numFmtId="164" formatCode="{MONEY_FORMAT}"/><numFmt numFmtId="165" formatCode="{DATE_FORMAT}"/></numFmts>
<fonts count="6">{FONTS}</fonts><fills count="1"><fill/></fills><borders count="2"><border/><border><bottom style="thin"/></border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>
<cellXfs count="9"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/><xf fontId="2" applyFont="1"/><xf fontId="3" applyFont="1"/><xf fontId="4" applyFont="1"/><xf fontId="5" applyFont="1"/><xf fontId="1" borderId="1" applyFont="1" applyBorder="1"/></cellXfs></styleSheet>"""
PLAIN, BOLD, MONEY, DAY, WARN, GOOD, BAD, TITLE, HEAD = range(9)


#: Characters that XML 1.0 cannot hold.
FORBIDDEN = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def cell(at: str, value, style: int) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, str):
        return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(FORBIDDEN.sub("", value))}</t></is></c>'
    return f'<c r="{at}" s="{style}"><v>{value}</v></c>'


def sheet(rows: list[list[tuple]], widths: list[int], freeze: bool) -> str:
    body = "".join(f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", v, s) for j, (v, s) in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>' if freeze else ""
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    rest = f'<autoFilter ref="A1:{chr(64 + len(widths))}{len(rows)}"/>' if freeze else ""
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{view}<cols>{cols}</cols><sheetData>{body}</sheetData>{rest}</worksheet>'


def workbook(transactions: list[list[tuple]], summary: list[list[tuple]]) -> bytes:
    out = io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{TYPES}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{TYPES}.worksheet+xml"/>' for i in (1, 2)) + f'<Override PartName="/xl/styles.xml" ContentType="{TYPES}.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets><sheet name="Transactions" sheetId="1" r:id="r1"/><sheet name="Summary" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2)) + f'<Relationship Id="r3" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/worksheets/sheet1.xml", sheet(transactions, [w for _, w in HEADINGS], True))
        z.writestr("xl/worksheets/sheet2.xml", sheet(summary, [30, 42], False))
    return out.getvalue()


AMOUNTS = ("Opening balance", "Total debits", "Total credits", "Closing balance", "Opening + credits − debits")


def value_of(label: str | None, value: str | None) -> tuple:
    if label in AMOUNTS and value is not None:
        return float(value), MONEY
    if label == "Reconciles":
        return value, GOOD if value == "Yes" else BAD
    return (int(value) if label in ("Transactions", "Pages") and value else value), PLAIN


def workbooks(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """(statement_id, content): a workbook per statement, made where its rows are. A statement has 20,000
    rows at most (the export limit), so its list fits a row. `summary` is that of workbook_summary()."""
    fields = ("serial", "txn_date", "value_date", "narration", "ref_no", "debit", "credit", "balance", "confidence", "issues")
    days = lambda c: F.datediff(c, F.lit("1899-12-30").cast("date"))
    flat = rows.select("statement_id", "serial", days("txn_date").alias("txn_date"), days("value_date").alias("value_date"), "narration", "ref_no", *(F.col(c).cast("double").alias(c) for c in ("debit", "credit", "balance")), "confidence", F.array_join("issues", "; ").alias("issues"))
    listed = flat.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    labels = summary.groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "label", "value"))).alias("lines"))
    kinds = {"txn_date": DAY, "value_date": DAY, "debit": MONEY, "credit": MONEY, "balance": MONEY}

    def make(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for mine, lines in zip(pdf["rows"], pdf["lines"], strict=True):
                body = [[(h, HEAD) for h, _ in HEADINGS]]
                for r in mine:
                    body.append([(r[f], WARN if f == "confidence" and r[f] != "high" else kinds.get(f, PLAIN)) for f in fields])
                shown = [[(x["label"], TITLE if x["line_no"] == 0 else BOLD), value_of(x["label"], x["value"])] for x in lines]
                out.append(workbook(body, shown))
            yield pd.DataFrame({"statement_id": pdf["statement_id"], "content": out})

    kind = rows.schema["statement_id"].dataType.simpleString()
    return listed.join(labels, "statement_id").mapInPandas(make, f"statement_id {kind}, content binary")
