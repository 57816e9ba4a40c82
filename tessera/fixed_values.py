"""Fixed values.

These strings and numbers must equal the ones the original system uses, or the
results differ (prompts, lexicons, rule tables, thresholds).  They are stated
plainly and in their natural order; every operator takes them as parameters
so callers can replace them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original system for identical results)
# ---------------------------------------------------------------------------

# Quality filter presets: (min question chars, min answer chars,
# max answer chars, max question chars or None, question must end with '?')
QUALITY_PRESETS = {
    "A": (10, 50, 5000, None, True),
    "B": (10, 50, 8000, None, False),
    "C": (10, 50, 8000, 2000, False),
}

INSTRUCTION_TEXT = "Trả lời câu hỏi pháp luật sau:"

TRAIN_SYSTEM_PROMPT = "You are a helpful assistant that answers questions about Vietnamese law."
LLAMA_BEGIN = "<|begin_of_text|>"
LLAMA_SYSTEM_HEADER = "<|start_header_id|>system<|end_header_id|>"
LLAMA_USER_HEADER = "<|start_header_id|>user<|end_header_id|>"
LLAMA_ASSISTANT_HEADER = "<|start_header_id|>assistant<|end_header_id|>"
LLAMA_EOT = "<|eot_id|>"
END_TOKENS = ["<|eot_id|>", "<|end_of_text|>", "<|im_end|>"]

SERVING_DEFAULT_SYSTEM = (
    "Bạn là một chuyên gia tư vấn pháp luật Việt Nam với nhiều năm kinh nghiệm. "
    "Hãy trả lời các câu hỏi một cách chính xác, chi tiết và dễ hiểu. "
    "Luôn dẫn nguồn từ các văn bản pháp luật cụ thể khi có thể."
)
CHAT_HISTORY_SYSTEM = "You are an amazing virtual assistant"

RAG_SYSTEM_PROMPT = """Bạn là trợ lý AI chuyên về tư vấn pháp luật Việt Nam. Nhiệm vụ của bạn là:
1. Trả lời câu hỏi dựa trên các tài liệu pháp luật được cung cấp
2. Trích dẫn chính xác các điều khoản, khoản, điểm từ văn bản pháp luật
3. Giải thích rõ ràng, dễ hiểu cho người không chuyên
4. Nếu thông tin không đủ trong tài liệu, hãy nói rõ điều đó
5. Luôn đưa ra câu trả lời có căn cứ pháp lý

QUAN TRỌNG: Chỉ sử dụng thông tin từ các tài liệu được cung cấp bên dưới."""
DOC_PROMPT_HEADER = "Tài liệu tham khảo: \n"
DOC_PROMPT_QUESTION = "Câu hỏi: "
DOC_PROMPT_ANSWER = " \n Câu trả lời: "
DOC_PROMPT_SEPARATOR = " \n\n"
RAG_USER_QUESTION = "\n\nCâu hỏi: "
RAG_USER_TAIL = "\n\nHãy trả lời dựa trên các tài liệu pháp luật trên."

HISTORY_ROLE_LABELS = {"user": "Người dùng: ", "assistant": "Trợ lý: "}

# Content type rules, checked in this order; first match wins.
CONTENT_TYPE_RULES = [
    ("law", ["luật", "bộ luật", "pháp luật"]),
    ("decree", ["nghị định", "quyết định"]),
    ("circular", ["thông tư", "hướng dẫn"]),
    ("contract", ["hợp đồng", "giao kèo"]),
    ("case_law", ["án lệ", "phán quyết"]),
]
CONTENT_TYPE_DEFAULT = "general"

FOLLOW_UP_INDICATORS = ["đó", "này", "kia", "thế", "vậy", "nữa", "còn", "như vậy", "như thế"]

ROUTE_LABELS = ["legal_rag", "agent_tools", "web_search", "general_chat"]
CALC_KEYWORDS = ["tính", "kiểm tra", "hợp lệ", "đủ tuổi", "chia", "phạt", "thời hiệu"]
ROUTE_KEYWORD = "agent_tools"
ROUTE_DEFAULT = "legal_rag"

# Synonym lexicon for query expansion (base term -> synonyms), in order.
LEGAL_EXPANSIONS = {
    "hợp đồng": ["hợp đồng", "giao kèo", "thỏa thuận", "hiệp định", "khế ước"],
    "giao kèo": ["hợp đồng", "giao kèo", "thỏa thuận"],
    "thỏa thuận": ["hợp đồng", "giao kèo", "thỏa thuận", "thoả thuận"],
    "vi phạm": ["vi phạm", "phạm", "trái", "sai phạm", "không tuân thủ"],
    "phạt": ["phạt", "xử phạt", "tiền phạt", "phạt tiền", "chế재"],
    "phạt tiền": ["phạt tiền", "tiền phạt", "phạt", "xử phạt hành chính"],
    "thừa kế": ["thừa kế", "kế thừa", "gia tài", "di sản", "tài sản để lại"],
    "kế thừa": ["thừa kế", "kế thừa", "gia tài", "di sản"],
    "di sản": ["di sản", "thừa kế", "tài sản để lại", "gia tài"],
    "ly hôn": ["ly hôn", "li hôn", "chấm dứt hôn nhân", "giải chấm hôn nhân"],
    "hôn nhân": ["hôn nhân", "kết hôn", "lập gia đình", "lấy vợ lấy chồng"],
    "kết hôn": ["kết hôn", "hôn nhân", "lập gia đình", "cưới"],
    "thuế": ["thuế", "lệ phí", "phí", "thuế phí", "nghĩa vụ tài chính"],
    "lệ phí": ["lệ phí", "phí", "thuế", "phí dịch vụ"],
    "kiện tụng": ["kiện tụng", "tranh chấp", "tranh tụng", "tố tụng", "khởi kiện"],
    "tranh chấp": ["tranh chấp", "kiện tụng", "tranh tụng", "xung đột"],
    "khởi kiện": ["khởi kiện", "kiện", "đệ đơn kiện", "nộp đơn kiện"],
    "bồi thường": ["bồi thường", "đền bù", "bồi hoàn", "tôn tôn thường", "khắc phục thiệt hại"],
    "đền bù": ["đền bù", "bồi thường", "bồi hoàn", "khắc phục"],
    "tài sản": ["tài sản", "của cải", "bất động sản", "động sản", "tạ sản"],
    "bất động sản": ["bất động sản", "nhà đất", "đất đai", "tài sản bất động"],
    "nhà đất": ["nhà đất", "bất động sản", "đất đai", "tài sản bất động"],
    "doanh nghiệp": ["doanh nghiệp", "công ty", "doanh nghiệp", "tổ chức kinh tế"],
    "công ty": ["công ty", "doanh nghiệp", "tổ chức kinh tế", "pháp nhân"],
    "tội": ["tội", "tội phạm", "hành vi vi phạm pháp luật", "vi phạm hình sự"],
    "án": ["án", "bản án", "quyết định của tòa", "phán quyết"],
    "tù": ["tù", "giam giữ", "hạn chế tự do", "án phạt tù"],
    "thủ tục": ["thủ tục", "quy trình", "trình tự", "các bước thực hiện"],
    "giấy tờ": ["giấy tờ", "hồ sơ", "tài liệu", "chứng từ"],
    "đăng ký": ["đăng ký", "ghi danh", "khai báo", "thông báo"],
}
MAX_EXPANSIONS = 5

# Contract penalty: cap as a share of the contract value, and the two notes.
PENALTY_CAP = 0.12
PENALTY_NOTE_CAPPED = "Đã áp dụng mức phạt tối đa 12% giá trị hợp đồng"
PENALTY_NOTE_AGREED = "Tính theo tỷ lệ phạt đã thỏa thuận"
CURRENCY_SUFFIX = " VNĐ"

# Legal age rules: action -> (min age, partial age or 0, description,
# partial note, note).  Unknown actions fall back to sign_contract.
AGE_RULES = {
    "sign_contract": (18, 15, "Đủ 18 tuổi để ký hợp đồng (Điều 21 Bộ luật Dân sự 2015)",
                      "Từ 15-18 tuổi cần có sự đồng ý của người đại diện hợp pháp", ""),
    "marriage": (18, 0, "Nam đủ 20 tuổi, Nữ đủ 18 tuổi (Điều 8 Luật Hôn nhân và Gia đình 2014)",
                 "", "Nam: 20 tuổi, Nữ: 18 tuổi"),
    "work": (15, 0, "Đủ 15 tuổi được làm việc (Điều 143 Bộ luật Lao động 2019)",
             "", "Dưới 15 tuổi chỉ làm công việc nghệ thuật với điều kiện đặc biệt"),
    "criminal_responsibility": (16, 14, "Đủ 16 tuổi chịu trách nhiệm hình sự (Điều 12 Bộ luật Hình sự 2015)",
                                "Từ 14-16 tuổi chỉ chịu trách nhiệm với tội đặc biệt nghiêm trọng", ""),
}
AGE_DEFAULT_ACTION = "sign_contract"
AGE_STATUS_YES = "Đủ điều kiện"
AGE_STATUS_PARTIAL_PREFIX = "Có điều kiện: "
AGE_STATUS_NO = "Chưa đủ điều kiện"

# Inheritance: first-rank heirs share equally.
INHERITANCE_BASIS = "Điều 651 Bộ luật Dân sự 2015 - Người thừa kế hàng thứ nhất chia đều"
INHERITANCE_NOTE = "Áp dụng cho thừa kế theo pháp luật, hàng thừa kế thứ nhất"
INHERITANCE_MINOR_NOTE = "Người chưa thành niên, cần người đại diện quản lý tài sản"
INHERITANCE_NO_HEIRS = "Không có người thừa kế"

# Business name rules.
PROHIBITED_NAME_WORDS = ["việt nam", "quốc gia", "chính phủ", "nhà nước", "đảng", "bộ", "ban", "ngành", "ủy ban"]
NAME_ISSUE_TEMPLATE = "Tên không được chứa từ '{word}' (Điều 36 Luật Doanh nghiệp 2020)"
NAME_MIN_LENGTH = 5
NAME_WARN_SHORT = "Tên doanh nghiệp quá ngắn, nên có ít nhất 5 ký tự"
NAME_SPECIAL_CHARS = "!@#$%^&*()_+=[]{};'\\:\"|,.<>?/~`"
NAME_WARN_SPECIAL = "Tên chứa ký tự đặc biệt, có thể gây khó khăn trong đăng ký"
NAME_WARN_DIGIT = "Tên bắt đầu bằng số, nên bắt đầu bằng chữ cái"
NAME_STATUS_VALID = "Hợp lệ"
NAME_STATUS_INVALID = "Không hợp lệ"
NAME_LEGAL_BASIS = "Điều 36 Luật Doanh nghiệp 2020"

# Statute of limitations: case type -> (general period, description,
# start date, exceptions, details).
STATUTES = {
    "civil": ("3 năm",
              "Thời hiệu khởi kiện chung là 3 năm (Điều 155 Bộ luật Dân sự 2015)",
              "Từ ngày người có quyền yêu cầu biết hoặc phải biết quyền và lợi ích hợp pháp bị xâm phạm",
              ["Tranh chấp quyền sở hữu đất đai: 10 năm",
               "Yêu cầu công nhận cha, mẹ, con: Không có thời hiệu",
               "Bồi thường thiệt hại ngoài hợp đồng: 3 năm"],
              None),
    "labor": ("1 năm",
              "Thời hiệu khởi kiện tranh chấp lao động là 1 năm (Điều 193 Bộ luật Lao động 2019)",
              "Từ ngày quyền, lợi ích bị xâm phạm",
              ["Tranh chấp về tiền lương, trợ cấp thôi việc: 2 năm",
               "Sa thải trái pháp luật: 1 năm"],
              None),
    "administrative": ("1 năm",
                       "Thời hiệu khởi kiện hành chính là 1 năm (Điều 31 Luật TTHC 2015)",
                       "Từ ngày nhận được quyết định hành chính hoặc biết quyết định",
                       ["Quyết định xử phạt vi phạm hành chính: 1 năm",
                        "Quyết định thu hồi đất: 1 năm"],
                       None),
    "criminal": ("Tùy mức hình phạt",
                 "Thời hiệu truy cứu trách nhiệm hình sự (Điều 27 Bộ luật Hình sự 2015)",
                 "Từ ngày thực hiện tội phạm",
                 None,
                 ["Phạm tội ít nghiêm trọng: 5 năm",
                  "Phạm tội nghiêm trọng: 10 năm",
                  "Phạm tội rất nghiêm trọng: 15 năm",
                  "Phạm tội đặc biệt nghiêm trọng: 20 năm",
                  "Tội phạm chiến tranh, tội phạm chống loài người: Không có thời hiệu"]),
}
STATUTE_ERROR_TEMPLATE = "Loại vụ việc '{case_type}' không hợp lệ"

# Web result rendering.
WEB_HEADER = "Kết quả tìm kiếm cho: "
WEB_ANSWER_HEADER = "Tóm tắt AI:\n"
WEB_DETAILS = "Chi tiết:\n"
WEB_URL_PREFIX = "   URL: "
WEB_SCORE_PREFIX = "   Độ liên quan: "
WEB_NONE_FOUND = "Không tìm thấy kết quả.\n"
WEB_SNIPPET_HEADER = "Dựa trên tìm kiếm web:\n"
WEB_NO_INFO = "Không tìm thấy thông tin."

# Query checks.
QUERY_ERR_EMPTY = "Query must be a non-empty string"
QUERY_ERR_SHORT = "Query too short (minimum 5 characters)"
QUERY_ERR_LONG = "Query too long (maximum 1000 characters)"
QUERY_ERR_ALPHA = "Query must contain alphabetic characters"
QUERY_OK = "Valid query"

# Retrieval constants.
SESSION_TTL_SECONDS = 360
DENSE_LIMIT = 4
DENSE_THRESHOLD = 0.3
BM25_TOP_K = 5
BM25_K1 = 1.5
BM25_B = 0.75
HYBRID_LIMIT = 10
HYBRID_BOTH_WEIGHT = 0.5
HYBRID_BOTH_BONUS = 0.1
HYBRID_SINGLE_WEIGHT = 0.6
FALLBACK_LIMIT = 5
RERANK_TOP_N = 3
POINT_ID_STRIDE = 1000
CHUNK_TOKENS = 512
CHUNK_OVERLAP = 50
SENTENCE_CHUNK_TOKENS = 2048
SCROLL_LIMIT = 1000
SPLIT_RATIOS = (0.8, 0.1, 0.1)
SPLIT_SEED = 42
HISTOGRAM_BINS = 50
