"""Default rule tables; every operator that uses one takes another as an argument.

Fixed values: names, word lists, patterns and weights that results must agree on.
"""

from __future__ import annotations

SECTION_RULES = [
    ("Header", r"CỘNG HÒA|ĐẢNG ỦY|BAN XÂY DỰNG"),
    ("Số ký hiệu", r"^Số\s*[:：]"),
    ("Kính gửi", r"Kính gửi"),
    ("Căn cứ", r"Căn cứ"),
    ("Điều", r"^(Điều|I\.|II\.|III\.|\d+\.)"),
    ("Nơi nhận", r"Nơi nhận"),
]
TYPE_RANKS = {"Quy định": 1, "Quyết định": 2, "Kế hoạch": 3, "Công văn": 4, "Báo cáo": 5}
UNKNOWN_RANK = 99
KNOWLEDGE_FIELDS = {
    "Tổ chức": ["tổ chức", "cán bộ", "đảng viên", "chi bộ", "biên chế"],
    "Tuyên giáo": ["tuyên giáo", "nghị quyết", "tuyên truyền", "học tập"],
    "Dân vận": ["dân vận", "mặt trận", "dân tộc", "tôn giáo"],
    "Tổng hợp": ["báo cáo", "tổng hợp", "chuyển đổi số", "phối hợp"],
    "Lãnh đạo điều hành": ["chỉ đạo", "lãnh đạo", "điều hành"],
}
CATALOGUE_FIELDS = {**KNOWLEDGE_FIELDS, "Tổ chức": ["tổ chức", "cán bộ", "đảng viên", "chi bộ"]}
DOCUMENT_TYPES = [
    ("Công văn", r"\bCÔNG VĂN\b|\bCV\b"),
    ("Kế hoạch", r"\bKẾ HOẠCH\b|\bKH\b"),
    ("Báo cáo", r"\bBÁO CÁO\b|\bBC\b"),
    ("Thông báo", r"\bTHÔNG BÁO\b|\bTB\b"),
    ("Tờ trình", r"\bTỜ TRÌNH\b|\bTTr\b"),
    ("Quyết định", r"\bQUYẾT ĐỊNH\b|\bQĐ\b"),
]
AGENCY_SIGNALS = ["BAN XÂY DỰNG ĐẢNG", "ĐẢNG ỦY", "TỈNH ỦY", "HUYỆN ỦY"]
SIGNER_TITLES = ["TRƯỞNG BAN", "PHÓ TRƯỞNG BAN", "BÍ THƯ", "PHÓ BÍ THƯ"]
BOILERPLATE = ["CỘNG HÒA", "ĐỘC LẬP", "SỐ:", "ĐẢNG ỦY", "BAN XÂY DỰNG"]
SUBJECT_MARKS = ["v/v", "về việc"]
KNOWLEDGE_STOPWORDS = ["của", "cho", "các", "văn", "bản", "ngày", "tháng", "năm", "theo", "trong", "với", "nơi", "nhận"]
CATALOGUE_STOPWORDS = ["của", "cho", "các", "văn", "bản", "ngày", "tháng", "năm", "được", "theo", "trong", "với", "trên", "dưới", "nơi", "nhận"]
TEMPLATE_STOPWORDS = ["văn", "bản", "công", "việc", "theo", "cho", "các", "mẫu", "nội", "dung"]
NORMALIZED_TYPES = [
    ("cong van", "cong_van"), ("bao cao", "bao_cao"), ("ke hoach", "ke_hoach"), ("to trinh", "to_trinh"),
    ("thong bao", "thong_bao"), ("giay moi", "giay_moi"), ("quy dinh", "quy_dinh"), ("quyet dinh", "quyet_dinh"),
]
#: First match wins: signals in the folded agency (any), all of them, or in the folded type; level, score.
AUTHORITY_LEVELS = {"central": 0.95, "internal": 0.88, "party_committee": 0.84, "normative": 0.78, "known_agency": 0.62, "unknown": 0.2}
AUTHORITY_SIGNALS = {"central": ["trung uong", "bo chinh tri", "ban bi thu"], "party_committee": ["dang uy", "huyen uy", "tinh uy"], "normative": ["quyet dinh", "quy dinh"]}
INTENTS = {
    "Cong van": ["cong van", "de nghi", "kinh gui", "phoi hop", "trien khai"],
    "Bao cao": ["bao cao", "ket qua", "tinh hinh", "danh gia", "kien nghi"],
    "Ke hoach": ["ke hoach", "muc dich", "yeu cau", "tien do", "to chuc thuc hien"],
    "To trinh": ["to trinh", "trinh", "xin chu truong", "phe duyet", "xem xet"],
    "Thong bao": ["thong bao", "thong tin", "ket luan", "lich lam viec"],
    "Giay moi": ["giay moi", "moi hop", "tham du", "hoi nghi", "cuoc hop"],
}
LOW_CONFIDENCE = 0.55
REQUIRED_INFORMATION = {
    "Công văn": {
        "đơn vị nhận/nơi nhận": ["kính gửi", "gửi", "nơi nhận"],
        "nội dung đề nghị": ["đề nghị", "phối hợp", "triển khai", "báo cáo"],
        "thời hạn xử lý": ["trước ngày", "hạn", "thời hạn", "ngày"],
    },
    "Báo cáo": {
        "phạm vi báo cáo": ["tình hình", "kết quả", "đánh giá"],
        "số liệu hoặc nội dung chính": ["số liệu", "kết quả", "nội dung"],
        "kiến nghị/đề xuất": ["kiến nghị", "đề xuất", "phương hướng"],
    },
    "Kế hoạch": {
        "mục đích/yêu cầu": ["mục đích", "yêu cầu"],
        "nội dung thực hiện": ["nội dung", "nhiệm vụ"],
        "thời gian thực hiện": ["thời gian", "tiến độ", "ngày"],
    },
}
TEMPLATE_HEADINGS = [
    ("Căn cứ", "Căn cứ"), ("Kính gửi", "Nơi nhận xử lý"), ("Nội dung", "Nội dung"),
    ("Tổ chức thực hiện", "Tổ chức thực hiện"), ("Nơi nhận", "Nơi nhận"),
]
DRAFT_CHECKS = [
    ("Quốc hiệu", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"), ("Tiêu ngữ", "Độc lập - Tự do - Hạnh phúc"),
    ("Số ký hiệu", "Số:"), ("Nơi nhận", "Nơi nhận:"), ("Chữ ký", "TRƯỞNG BAN"),
]
#: status now, action, status after it.
REVIEW_STEPS = [
    ("pending_outline_review", "approve_outline", "outline_approved"), ("outline_approved", "generate_draft", "pending_user_review"),
    ("pending_user_review", "save_review", "pending_user_review"), ("approved", "save_review", "pending_user_review"),
    ("pending_user_review", "approve_draft", "approved"), ("approved", "export", "exported"),
]
ACCEPTED_EXTENSIONS = ["txt", "docx", "doc", "pdf", "xlsx", "xls"]
MAX_CHUNK_TOKENS, VECTOR_SIZE, TOP_KEYWORDS = 180, 128, 20
#: Reasons that the rankings of documents and of templates give, and those of authority and of relations.
RANKING_A = {"type": "Cung loai van ban", "internal": "Uu tien van ban noi bo Ban Xay dung Dang", "words": "Trung tu khoa: ", "none": "Mẫu trong kho văn bản"}
RANKING_B = {"type": "Cùng loại văn bản", "field": "Cùng lĩnh vực", "words": "Trùng từ khóa: ", "ready": "Đã phân tích bố cục", "none": "Mẫu sẵn có trong kho"}
ANALYSED = "Đã phân tích"
AUTHORITY_REASONS = {
    "central": "Cơ quan cấp trung ương", "internal": "Văn bản nội bộ Ban Xây dựng Đảng", "party_committee": "Cơ quan Đảng cấp ủy",
    "normative": "Loại văn bản có tính quy định", "known_agency": "Có cơ quan ban hành", "unknown": "Thiếu cơ quan ban hành",
}
RELATION_REASONS = {
    "references": "Trùng số/ký hiệu văn bản", "reports": "Báo cáo cùng lĩnh vực với văn bản triển khai",
    "implements": "Văn bản triển khai liên hệ văn bản quy định/quyết định", "related": "Cùng lĩnh vực",
}
LIBRARY_STATUSES = ["new", "indexed", "failed", "need_ocr", "need_review", "duplicate", "unsupported", "deleted"]
TEMPLATE_EXTENSIONS = [".doc", ".docx", ".pdf"]
MAX_TEMPLATE_BYTES = 50 * 1024 * 1024
#: Task statuses, and the filter value for all of them.
PENDING, DOING, WAITING, DONE, ALL = "Chưa thực hiện", "Đang thực hiện", "Chờ duyệt", "Hoàn thành", "Tất cả"
#: Folded signals of an internal agency: the first alone, or the others together.
INTERNAL_AGENCY = ("ban xay dung dang", ["ban", "dang"])
#: Template sections: of the lines before any heading, and of capital lines; texts of a template's summary.
OPENING, HEADING = "Mở đầu", "Tiêu đề"
SUMMARY_LAYOUT, SUMMARY_OPENING = "Bố cục nhận diện: ", " Mở đầu mẫu: "
#: Format signals: all of some of these lists must occur.
FORMAT_SIGNALS = {
    "has_national_header": [["cộng hòa xã hội chủ nghĩa việt nam"]], "has_motto": [["độc lập"], ["tự do"], ["hạnh phúc"]], "has_document_number": [["số:", "số "]],
    "has_recipient": [["kính gửi", "nơi nhận"]], "has_signature_block": [["người ký", "trưởng ban", "kt."]],
}
LENGTH_CHECK, UNTITLED, UNNAMED = "Dung lượng nội dung", "Văn bản", "Văn bản chưa đặt tên"
#: Patterns of a document's number, of dates in long and short form, and of reference numbers.
NUMBER_LABEL = r"(?iu)Số\s*[:：]\s*([0-9A-Za-zÀ-ỹ/.\-]+)"
LONG_DATE, SHORT_DATE = r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
REFERENCE_NUMBER = r"(?U)\b\d{1,4}[-/][A-Za-zÀ-ỹ0-9./-]+"
