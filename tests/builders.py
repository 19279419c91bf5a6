"""Small office files and PDFs, built here."""

import io
import zipfile
import zlib

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, props="": f'<w:r>{props}<w:t xml:space="preserve">{t}</w:t></w:r>'
    body = f"<w:p>{run('Title')}</w:p><w:p>{run('Plain ')}{run('bold', '<w:rPr><w:b/></w:rPr>')}</w:p><w:p/><w:tbl><w:tr><w:tc><w:p>{run('a1')}</w:p></w:tc><w:tc><w:p>{run('b1')}</w:p></w:tc></w:tr></w:tbl>"
    return archive({"word/document.xml": f"{HEAD}<w:document {w}><w:body>{body}</w:body></w:document>", "media/x.bin": b"\x00\x01"})


def pptx():
    ns = f'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="{REL}"'
    para = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    box = lambda *t: f"<p:sp><p:txBody>{''.join(map(para, t))}</p:txBody></p:sp>"
    cell = lambda t: f"<a:tc><a:txBody>{para(t)}</a:txBody></a:tc>"
    grid = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell('c1')}{cell('')}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    slide = lambda x: f"{HEAD}<p:sld {ns}><p:cSld><p:spTree>{x}</p:spTree></p:cSld></p:sld>"
    return archive({
        "ppt/presentation.xml": f'{HEAD}<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="rId2"/><p:sldId id="2" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="slides/b.xml"/><Relationship Id="rId2" Target="slides/a.xml"/></Relationships>',
        "ppt/slides/a.xml": slide(box("One", "Two") + f"<p:grpSp>{box('Inner')}</p:grpSp>"), "ppt/slides/b.xml": slide(box("Last") + grid),
    })


def xlsx():
    ns = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{REL}"'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c><c r="C1" t="str"><f>A1</f><v>x</v></c><c r="D1" t="b"><v>1</v></c></row><row r="5"><c r="D5" t="inlineStr"><is><t xml:space="preserve"> edge </t></is></c><c r="E5" t="s"><v>1</v></c></row>'
    return archive({
        "xl/workbook.xml": f'{HEAD}<workbook {ns}><sheets><sheet name="Main" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"{HEAD}<sst {ns}><si><t>Hello</t></si><si><t>  </t></si></sst>", "xl/worksheets/s.xml": f"{HEAD}<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>",
    })


def pdf(*pages, compress=False):
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * k} 0 R' for k in range(len(pages)))}] /Count {len(pages)} >>"]
    raw = [o.encode() for o in objects]
    for k, lines in enumerate(pages):
        shown = b"BT /F1 12 Tf 72 720 Td " + b" 0 -14 Td ".join(b"(" + x.encode("latin-1").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for x in lines) + b" ET"
        data = zlib.compress(shown) if compress else shown
        raw.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R >>".encode())
        raw.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if compress else b"", data))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, o) for k, o in enumerate(raw)) + b"trailer << /Root 1 0 R >>\n%%EOF"



MARKUP = "http://schemas.openxmlformats.org/markup-compatibility/2006"


def docx_with_prefixes():
    """As office applications write it: prefixes that only an attribute's value names, links and merged cells."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    ns = f'xmlns:mc="{MARKUP}" {w} xmlns:r="{REL}" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml" mc:Ignorable="w14 w15"'
    run = lambda t: f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>'
    link = f'<w:p><w:pPr/><w:hyperlink r:id="rId9">{run("linked ")}{run("text")}</w:hyperlink></w:p>'
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{run(t)}</w:p></w:tc>"
    table = f'<w:tbl><w:tr>{cell("wide", """<w:gridSpan w:val="2"/>""")}{cell("tall", """<w:vMerge w:val="restart"/>""")}</w:tr><w:tr>{cell("a")}{cell("b")}{cell("hidden", "<w:vMerge/>")}</w:tr></w:tbl>'
    body = f'<w:p w14:paraId="1A">{run("First")}</w:p>{link}{table}'
    return archive({"word/document.xml": f"{HEAD}<w:document {ns}><w:body>{body}</w:body></w:document>"})


def modern_pdf(text, key=False):
    """Objects in an object stream, a two-byte font with a ToUnicode map, and part of the text in a form."""
    codes = {c: k + 1 for k, c in enumerate(sorted(set(text)))}
    chars = "\n".join(f"<{k:04X}> <{c.encode('utf-16-be').hex()}>" for c, k in codes.items())
    cmap = f"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange {len(codes)} beginbfchar\n{chars}\nendbfchar 1 beginbfrange <0F00> <0F02> <0041> endbfrange endcmap".encode()
    coded = "".join(f"{codes[c]:04X}" for c in text)
    half = len(coded) // 8 * 4
    page = f"BT /F1 10 Tf 1 0 0 1 50 700 Tm [<{coded[:half]}> -20 <{coded[half:]}>] TJ 0 -12 Td <0F000F010F02> Tj ET q /Fm Do Q BI /W 1 ID \x00(not text) EI".encode("latin-1")
    form = b"BT /F2 9 Tf 50 600 Td (caf\\351 form) Tj ET"
    packed = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources 4 0 R >>", 3: "<< /Type /Page /Parent 2 0 R /Contents [10 0 R] >>",
              4: "<< /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /Fm 12 0 R >> >>", 5: "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 11 0 R >>", 6: "<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>"}
    heads, bodies = "", ""
    for n, body in packed.items():
        heads += f"{n} {len(bodies)} "
        bodies += body + " "
    streams = {7: (f"/Type /ObjStm /N {len(packed)} /First {len(heads)}", (heads + bodies).encode()), 10: ("", page), 11: ("", cmap), 12: ("/Type /XObject /Subtype /Form", form)}
    out = b"%PDF-1.7\n"
    for n, (head, data) in streams.items():
        data = zlib.compress(data)
        out += b"%d 0 obj\n<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, head.encode(), len(data), data)
    return out + (b"trailer << /Encrypt 9 0 R >>\n" if key else b"") + b"%%EOF"
