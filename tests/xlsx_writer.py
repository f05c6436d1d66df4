"""Tiny workbook writer for tests (stdlib zipfile only)."""

import zipfile
from xml.sax.saxutils import escape

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RNS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _col(i):
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path, sheets, inline=False):
    """sheets: {name: {row_no: [values]}}; str -> shared (or inline) string,
    bool -> boolean, numbers -> numeric."""
    shared, index = [], {}
    parts = {}
    for k, (name, rows) in enumerate(sheets.items(), start=1):
        xml_rows = []
        for rn in sorted(rows):
            cells = []
            for ci, v in enumerate(rows[rn]):
                if v is None:
                    continue
                ref = f"{_col(ci)}{rn}"
                if isinstance(v, bool):
                    cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, (int, float)):
                    cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                elif inline:
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                else:
                    if v not in index:
                        index[v] = len(shared)
                        shared.append(v)
                    cells.append(f'<c r="{ref}" t="s"><v>{index[v]}</v></c>')
            xml_rows.append(f'<row r="{rn}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{k}.xml"] = (f'<worksheet xmlns="{NS}"><sheetData>{"".join(xml_rows)}'
                                               f'</sheetData></worksheet>')
    wb = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, start=1))
    rels = "".join(f'<Relationship Id="rId{k}" Type="x" Target="worksheets/sheet{k}.xml"/>'
                   for k in range(1, len(sheets) + 1))
    sst = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="{RNS}"><sheets>{wb}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}'
                   f'</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">{sst}</sst>')
        for p, x in parts.items():
            z.writestr(p, x)
