import random
import re
import unicodedata

from pyspark.sql import functions as F

from folioframe.functions import rules as R
from folioframe.functions import text as X
from folioframe.operators import structure as S


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_tokens_and_folding_match_a_plain_model(spark):
    r = random.Random(1)
    letters = "aAbBđĐéÉơƠưữẮẵ 0 9\t\n-.,;ñÑüß"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(300)] + ["", "Kế hoạch   số 12", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def folded(t):
        t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn").replace("đ", "d")
        return re.sub(r"\s+", " ", t).strip()

    for row in df.select("t", X.tokens(F.col("t")).alias("w"), X.folded(F.col("t")).alias("f"), X.slug(F.col("t"), fold=True, default="x").alias("s")).collect():
        assert row.w == re.findall("[0-9A-Za-zÀ-ỹ]+", row.t.lower())
        assert row.f == folded(row.t)
        assert row.s == (re.sub("[^0-9a-zA-Z]+", "-", folded(row.t)).strip("-")[:90] or "x")


def test_numbers_and_dates(spark):
    t = F.col("t")
    assert one(spark, "Số: 12-KH/BXDĐ", X.document_number(t))[0] == "12-KH/BXDĐ"
    assert one(spark, "không có", X.document_number(t))[0] is None
    dates = [("ngày 5 tháng 3 năm 2024", "2024-03-05"), ("ngày 31 tháng 2 năm 2024, 1/2/2023", "2023-02-01"), ("31-02-2024", None), ("x 7-8-2021", "2021-08-07"), ("", None)]
    for text, want in dates:
        got = one(spark, text, X.issued_date(t))[0]
        assert (got and got.isoformat()) == want
    assert one(spark, "2026-02-30", X.iso_date_text(t))[0] == "2026-02-30"
    assert one(spark, None, X.iso_date_text(t))[0] is None


def test_like_folds_ascii_only(spark):
    assert one(spark, "Đảng ABC", X.ascii_like(F.col("t"), F.lit("%abc%")))[0]
    assert not one(spark, "Đảng ABC", X.ascii_like(F.col("t"), F.lit("%đảng%")))[0]


LETTER = "\n".join(["ĐẢNG ỦY TỈNH", "Số: 15-KH/TU", "Hà Nội, ngày 2 tháng 9 năm 2024", "KẾ HOẠCH", "V/v tổ chức học tập nghị quyết cho cán bộ", "Kính gửi: các chi bộ", "TRƯỞNG BAN", "Nguyễn Văn A"])


def test_metadata_of_a_letter(spark):
    df = spark.createDataFrame([(1, LETTER, "ke_hoach-15.txt"), (2, "", "trong.txt"), (3, None, None)], "doc_id long, text string, file_name string")
    a, b, c = (S.extracted_metadata(df).orderBy("doc_id")).collect()
    assert (a.document_number, str(a.issued_date), a.document_type, a.issuing_agency, a.signer) == ("15-KH/TU", "2024-09-02", "Kế hoạch", "ĐẢNG ỦY TỈNH", "Nguyễn Văn A")
    assert a.summary.startswith("V/v") and a.field in R.CATALOGUE_FIELDS and len(a.keywords) == 12
    assert (b.summary, b.title, b.field) == ("trong", "trong", None)
    assert c.title == "Văn bản chưa đặt tên"


def model_chunks(text, rules, most):
    out, section, buffer, n = [], "body", [], 0
    for line in [x.strip() for x in text.split("\n") if x.strip()]:
        opens = next((s for s, p in rules if re.search(p, line, re.I)), None)
        k = len(re.findall("[0-9A-Za-zÀ-ỹ]+", line.lower()))
        if buffer and (opens or n + k > most):
            out.append((section, "\n".join(buffer), n))
            buffer, n = [], 0
        section = opens or section
        buffer.append(line)
        n += k
    return out + ([(section, "\n".join(buffer), n)] if buffer else [])


def test_chunks_match_a_plain_model(spark):
    r = random.Random(3)
    pool = ["Điều 1. x", "Căn cứ luật", "Kính gửi ban", "Nơi nhận: a", "1. mục", " "] + [" ".join(["từ"] * n) for n in (1, 5, 60, 200)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(60)] + [LETTER, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for c in S.chunks(df).orderBy("doc_id", "chunk_order").collect():
        got.setdefault(c.doc_id, []).append((c.section, c.text, c.token_count))
    assert got == {i: m for i, t in enumerate(texts) if (m := model_chunks(t, R.SECTION_RULES, 180))}


def test_template_sections(spark):
    text = "mở\nCĂN CỨ\nKính gửi: A\nnội bộ\nb\nTIÊU ĐỀ LỚN\nNơi nhận: x\ncuối"
    rows = S.template_sections(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).orderBy("doc_id", "section_order").collect()
    assert [(r.doc_id, r.section_type, r.title, r.content) for r in rows] == [
        (1, "Mở đầu", "Mở đầu", "mở"), (1, "Nơi nhận xử lý", "Kính gửi: A", "nội bộ\nb"), (1, "Nơi nhận", "Nơi nhận: x", "cuối"), (2, "Mở đầu", "Mở đầu", ""),
    ]


def test_format_checks(spark):
    draft = "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\nSố: 1\n"
    got = {r.name: r.ok for r in S.format_review(spark.createDataFrame([(1, draft)], "draft_id long, content string")).collect()}
    assert got == {"Quốc hiệu": True, "Tiêu ngữ": True, "Số ký hiệu": True, "Nơi nhận": False, "Chữ ký": False, "Dung lượng nội dung": False}
    req = spark.createDataFrame([(1, "Đề nghị phối hợp", "Công văn"), (2, "tình hình", "Báo cáo"), (3, "", "lạ")], "request_id long, request_text string, document_type string")
    miss = {r.request_id: r.missing for r in S.missing_information(req).collect()}
    assert miss[1] == ["đơn vị nhận/nơi nhận", "thời hạn xử lý"] and len(miss[2]) == 2 and len(miss[3]) == 3


def test_templates_analysed(spark):
    df = spark.createDataFrame([(1, "Mẫu kế hoạch", LETTER)], "doc_id long, name string, text string")
    row = S.analysed_templates(df).first()
    assert row.has_document_number and row.has_recipient and row.status == "Đã phân tích" and row.summary.startswith("Bố cục nhận diện")
