"""Word lists and values that results depend on. Arabic words are in normalised spelling where rules compare them so."""

from __future__ import annotations

#: Arabic words that carry no subject.
ARABIC_STOPWORDS = (
    "من", "في", "على", "الى", "الي", "عن", "مع", "هذا", "هذه", "ذلك", "تلك", "التي", "الذي", "الذين", "ما", "لا", "و", "او", "أو", "ثم", "قد", "كان", "كانت", "يكون",
    "تكون", "هو", "هي", "هم", "هن", "انا", "نحن", "انت", "انتم", "كل", "بعض", "غير", "بين", "عند", "لدى", "حتى", "اذا", "إذا", "لكن", "لأن", "لان", "بعد", "قبل", "حول",
    "ضد", "دون", "سوى", "مثل", "هناك", "هنالك", "ايضا", "أيضا", "كما", "لقد", "منذ", "خلال", "عبر", "نحو", "ولا", "وما", "وهو", "وهي", "التى", "اللتي", "اي", "أي",
    "ان", "أن", "إن", "الا", "إلا", "به", "بها", "له", "لها", "فيه", "فيها", "عليه", "عليها", "منه", "منها",
)

#: English words that carry no subject.
ENGLISH_STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "at", "by", "is", "are", "was", "were", "be", "been", "with", "from", "as", "that", "this", "these",
    "those", "it", "its", "if", "then", "than", "but", "not", "no", "nor", "so", "such", "which", "who", "whom", "what", "when", "where", "how", "all", "any", "each",
    "both", "few", "more", "most", "other", "some", "only", "own", "same", "too", "very", "can", "will", "just",
)

#: What a light stem takes off a word's beginning, the first that fits.
AR_PREFIXES = (
    "وال", "فال", "بال", "كال", "لل", "ال",
)

#: What it takes off a word's end, the first that fits.
AR_SUFFIXES = (
    "اتها", "اتهم", "ياته", "ات", "ون", "ين", "يه", "ها", "هم", "كم", "نا",
)

#: Months in order.
MONTHS_AR = (
    "يناير", "فبراير", "مارس", "ابريل", "مايو", "يونيو", "يوليو", "اغسطس", "سبتمبر", "اكتوبر", "نوفمبر", "ديسمبر",
)

#: Months in order.
MONTHS_EN = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)

#: Headings about the document instead of its subject.
BOOKKEEPING = (
    "سجل الاصدارات", "سجل اصدارات", "سجل التعديلات", "سجل التغييرات", "سجل المراجعات", "تاريخ الاصدارات", "version history", "revision history", "change log",
    "changelog", "document history", "الملفات والتقارير المنتجه", "الملفات المنتجه", "التقارير المنتجه", "قائمه الملفات", "produced files", "generated files",
    "file list", "deliverables index", "جدول المحتويات", "المحتويات", "فهرس", "الفهرس", "table of contents", "index of sections", "بيانات وصفيه", "بطاقه سلامه",
    "سلامه سياقيه", "contextual integrity", "document metadata", "file metadata", "metadata", "سجل المحادثات", "مرجعي فقط", "conversation log", "for reference only",
)

#: Words by which a heading means its own document.
SELF_REFERENCE = (
    "هذا الملف", "هذه الوثيقه", "هذا المستند", "this file", "this document",
)

#: Questions about the document as an object.
ABOUT_DOCUMENT = (
    "اصدار", "الاصدار", "اصدارات", "الاصدارات", "نسخه الملف", "نسخه المستند", "رقم النسخه", "سجل التعديلات", "سجل التغييرات", "سجل المراجعات", "تاريخ الرفع", "متى رفع",
    "متى رفعت", "من رفع", "حجم الملف", "عدد الملفات", "كم ملف", "قائمه الملفات", "الملفات المنتجه", "التقارير المنتجه", "جدول المحتويات", "المحتويات", "فهرس",
    "بيانات وصفيه", "بطاقه سلامه", "version", "versions", "changelog", "change log", "revision", "revisions", "uploaded", "upload date", "file size", "how many files",
    "list of files", "produced files", "generated files", "table of contents", "metadata",
)

#: A passage says that it holds.
CURRENT = (
    "النافذه", "النافذ", "الناقذه", "الساريه", "الساري", "المعمول به", "المعمول بها", "المصحح", "المصححه", "بعد التصحيح", "تصحيحا لخطا سابق", "تصحيح خطا سابق",
    "قراءه نهائيه", "تحقق حاسم", "النسخه النهائيه", "الصيغه النهائيه", "المعتمده نهائيا", "المعتمد نهائيا", "يعتمد عليه", "يعتد به", "التذكيرات الدائمه", "in force",
    "currently in force", "effective version", "corrected version", "final version", "as corrected", "supersedes", "authoritative",
)

#: A passage says that it no longer holds.
SUPERSEDED = (
    "ملغى", "ملغاه", "ملغي", "لم يعد ساريا", "لم تعد ساريه", "لم يعد مطلوبا", "نسخه قديمه", "الاصدار السابق", "النسخه السابقه", "الصيغه السابقه", "مستبدل", "مستبدله",
    "استبدل بـ", "قبل التصحيح", "الصيغه المرفوضه", "superseded", "superseded by", "obsolete", "deprecated", "no longer in force", "no longer applies", "replaced by",
    "previous version", "earlier version",
)

#: A sentence declares a value to be in force.
IN_FORCE = (
    "النافذه", "النافذ", "الساريه", "الساري", "المعمول به", "المعمول بها", "المعتمده نهائيا", "المعتمد نهائيا", "بعد التصحيح", "المصحح", "المصححه", "يعتد به",
    "يعتمد عليه", "in force", "currently in force", "as corrected", "effective version",
)

#: A sentence retires a part of a document.
DELETED = (
    "محذوف", "محذوفه", "محذوفان", "ملغى", "ملغاه", "لم يعد ساريا", "لم تعد ساريه", "شطب", "deleted", "removed", "struck out", "no longer in force",
)

#: Questions that ask for the newest state.
LATEST = (
    "اخر", "احدث", "الاحدث", "الاخيره", "الاخير", "المستجدات", "مستجدات", "تطورات", "الوضع الحالي", "الوضع الراهن", "الحالي", "الحاليه", "الراهن", "الراهنه", "حاليا",
    "الان", "حتى الان", "لغايه الان", "ما وصلنا اليه", "اين وصلنا", "ما استجد", "ماذا استجد", "النهائيه المعتمده", "latest", "most recent", "newest", "current",
    "currently", "current status", "current state", "right now", "up to date", "so far", "as things stand", "where do we stand", "last update", "recent",
)

#: Questions that ask for the beginning.
EARLIEST = (
    "اول", "الاولى", "الاول", "البدايه", "في البدايه", "بدايه", "الاصلي", "الاصليه", "اصلا", "سابقا", "في السابق", "الاولي", "المبدئي", "المبدئيه", "original",
    "originally", "initial", "initially", "at the start", "first", "earliest", "previously", "originally agreed",
)

#: Cues of a question's intent, in the order in which they are tried.
INTENTS = {
    "comparison": ("قارن", "الفرق بين", "مقارنة", "مقابل", "compare", "difference between", "versus",),
    "timeline": ("تسلسل", "التسلسل الزمني", "ترتيب الاحداث", "منذ", "حتى", "بالتواريخ", "بالتاريخ", "اخر تحديثات", "اخر التحديثات", "تحديثات", "المستجدات", "اخر المستجدات", "مستجدات", "تطورات", "اخر تطورات", "ماذا استجد", "ما استجد", "سير القضيه", "مراحل", "timeline", "chronology", "sequence of events", "latest updates", "recent updates",),
    "aggregation": ("جميع", "كل", "اذكر", "ما هي البنود", "قائمة", "list all", "all the", "enumerate",),
    "procedure": ("اجراءات", "كيف", "خطوات", "procedure", "how do", "how to", "steps",),
    "reason": ("لماذا", "سبب", "لماذا تعد", "why", "reason",),
    "date": ("متى", "تاريخ", "بتاريخ", "when", "date of",),
    "numeric": ("كم", "بكم", "سعر", "تسعير", "ما قيمة", "ما نسبة", "ما مبلغ", "ما عدد", "ما مقدار", "how much", "how many", "what is the value", "amount", "rate",),
    "entity": ("من هم", "من هو", "من هي", "من يمثل", "الاطراف", "who is", "who are", "which company", "parties",),
}

#: Questions that want all of something listed.
EXHAUSTIVE = (
    "من هم", "من هن", "ما هي الشركات", "ما هي الاطراف", "من حضر", "من الحاضرون", "اذكر جميع", "اذكر كل", "جميع", "كل الاطراف", "قائمة", "عدد لي", "اسرد", "who are",
    "list all", "all the parties", "enumerate",
)

#: Questions about who holds a role.
ROLE = (
    "الممثل القانوني", "من يمثل", "من يمثلها", "ما دور", "ما هو دور", "المسؤول عن", "صاحب", "مالك", "بصفته", "بصفة", "role of", "who represents", "responsible for",
)

#: Questions that want an overview.
OVERVIEW = (
    "احكي", "احكيلي", "احكي لي", "لخص", "لخصلي", "اعطني ملخص", "اعطيني ملخص", "عايز ملخص", "ملخص عن", "نبذه عن", "معلومات عن", "كل شيء عن", "كل حاجه عن", "ايه اللي في",
    "ماذا يحتوي", "محتوي الملف", "عن الملف", "عن هذا الملف", "tell me about", "summarize", "summarise", "overview", "what is in", "information about",
    "information regarding", "everything about", "brief me",
)

#: Question words.
INTERROGATIVES = (
    "من", "كم", "متى", "اين", "لماذا", "كيف", "ما", "ماهي", "هل", "who", "what", "when", "where", "why", "how", "which",
)

#: Questions that only an operational system can answer.
LIVE_DATA = (
    "حاليا", "الحالي", "الحاليه", "الان", "هذه اللحظه", "حتى الان", "اخر تحديث", "المحدث", "الرصيد", "الارصده", "المخزون", "المتوفر", "المتبقي", "الكميه المتاحه",
    "حاله المورد", "حاله الموظف", "حاله الطلب", "حاله امر الشراء", "قيد التنفيذ", "قيد الاعتماد", "المعلقه", "غير المسدده", "المستحقه", "هذا الشهر", "هذا الاسبوع",
    "هذه السنه", "اليوم", "امس", "الشهر الحالي", "السنه الحاليه", "كم عدد", "كم بلغ", "اجمالي المشتريات", "اجمالي المصروفات", "عدد اوامر الشراء", "عدد الطلبات",
    "current", "currently", "right now", "as of today", "latest", "up to date", "balance", "inventory", "stock level", "in stock", "outstanding", "pending", "overdue",
    "this month", "this week", "today", "how many", "total purchases", "open orders", "purchase orders",
)

#: Ends of hosts that rank first.
AUTHORITATIVE_SUFFIXES = (
    ".gov", ".gov.ae", ".gov.uk", ".mil", ".edu", ".ac.uk", ".ac.ae", ".int", ".who.int", ".un.org", ".europa.eu",
)

#: Hosts that rank first, with those below them.
AUTHORITATIVE_HOSTS = (
    "nasa.gov", "esa.int", "noaa.gov", "nist.gov", "cern.ch", "nature.com", "science.org", "britannica.com", "wikipedia.org", "iso.org", "ieee.org", "moec.gov.ae",
    "u.ae", "adjd.gov.ae", "mohre.gov.ae", "dm.gov.ae",
)

#: Parts of hosts that rank last.
LOW_QUALITY_HOSTS = (
    "pinterest.", "quora.com", "answers.", "ehow.com", "wikihow.com", "blogspot.", "medium.com", "reddit.com", "facebook.com", "x.com", "twitter.com",
)

#: Words that say what kind of document a file is, not which one.
KIND_WORDS = (
    "contract", "annex", "addendum", "no", "boq", "final", "revised", "actual", "with", "ps", "con", "fees", "specification", "specifications", "special", "general",
    "drawing", "drawings", "signed", "unsigned", "site", "plan", "material", "materials", "table", "offer", "price", "prices", "ref", "list", "report", "water",
    "supply", "fire", "fighting", "drainage", "electrical", "elec", "etisalat", "camera", "ac", "manufacturers", "str", "structural", "arch", "details", "summary",
    "payment", "payments", "project", "invoice", "letter", "rev", "copy", "draft", "approved", "stamped", "compiled", "tiles", "lpo", "عقد", "العقد", "المقاوله",
    "مقاوله", "للمشروع", "المشروع", "مشروع", "ملحق", "جدول", "الكميات", "كميات", "تقرير", "الخبره", "خبره", "النهايي", "نهايي", "مبديي", "حكم", "الحكم", "قطعي",
    "تمهيدي", "المستعجل", "مستعجل", "محضر", "الجلسه", "جلسه", "تاريخ", "مذكره", "نهاييه", "للخبره", "دفاع", "تعقيب", "كتاب", "الاستشاري", "الرد", "فحص", "التربه",
    "المعتمد", "المعتمده", "الاضرار", "محدث", "المواصفات", "الخاصه", "الملاحظات", "مع", "بعد", "المراجعه", "الاخير", "نسب", "الانجاز", "عرض", "سعر", "صحيفه", "الدعوي",
    "لايحه", "دعوي", "طلب", "تصحيح", "المامورية", "قرار", "المحكمه", "الشكوي", "الاولي", "الثانيه", "الانذار", "العدلي", "خطاب", "مقترح", "الفني", "الصادر",
)

#: Words that put a name after them as what another document is about.
ABOUT_WORDS = (
    "علي", "عن", "حول", "بشان", "ضد", "لتقرير", "اعتراض", "تعقيب", "رد",
)

#: Words before a name that point at a file.
FILE_WORDS = (
    "ملف", "الملف", "file", "document", "مستند", "المستند",
)

#: Kinds that a document is filed under, each with the words that give it away.
FILING = {
    "ملحق عقد": ("ملحق عقد", "ملحق العقد", "addendum", "contract amendment",),
    "أمر تغيير": ("أمر تغيير", "اوامر تغيير", "أعمال إضافية", "variation order", "variation", "change order",),
    "تمديد مدة": ("تمديد مدة", "تمديد المدة", "extension of time", "eot",),
    "جدول كميات": ("جدول الكميات", "جدول كميات", "bill of quantities", "boq",),
    "عرض سعر": ("عرض سعر", "عرض أسعار", "quotation", "price offer",),
    "دفعة / فاتورة": ("فاتورة", "مستخلص", "دفعة", "invoice", "payment certificate", "ipc", "payment",),
    "محضر اجتماع": ("محضر اجتماع", "محضر", "minutes of meeting", "meeting minutes", "mom",),
    "طلب معاينة / استفسار": ("طلب معاينة", "طلب استفسار", "inspection request", "request for information", "rfi",),
    "مخطط": ("مخطط", "drawing", "layout plan",),
    "مستند قضائي": ("محكمة", "حكم", "دعوى", "مذكرة", "خبير", "court", "judgment", "lawsuit",),
    "تقرير": ("تقرير", "report",),
    "خطاب": ("خطاب", "كتاب", "الموضوع", "subject:", "dear", "letter",),
    "عقد": ("عقد", "اتفاقية", "contract", "agreement",),
}

#: Words of a name that name no project.
GENERIC_NAMES = (
    "al", "el", "ال", "bin", "bint", "بن", "بنت", "mr", "mrs", "السيد", "السيده", "the", "of", "for", "and", "villa", "فيلا", "فيلة", "project", "مشروع", "private",
    "خاصة", "سكنية", "residential", "house", "منزل", "abdulla", "abdullah", "عبدالله", "عبد", "mohamed", "mohammed", "muhammad", "محمد", "ahmed", "احمد", "ali", "علي",
    "saeed", "سعيد", "khalid", "خالد", "rashid", "راشد", "sultan", "سلطان", "hasan", "حسن",
)

#: Types of document and their hints.
TYPE_HINTS = {
    "legal_case": ("دعوى", "المدعي", "المدعى عليه", "المحكمة", "جلسة", "قضية", "حكم", "خبير منتدب",),
    "method_statement": ("method statement", "permit to work", "hse", "excavation", "شروط السلامة",),
    "contract": ("عقد", "بنود العقد", "sub-clause", "fidic", "contract", "المقاول", "صاحب العمل",),
    "procedure": ("إجراء", "إجراءات", "procedure", "خطوات العمل",),
    "report": ("تقرير", "report", "findings", "النتائج",),
}

#: What a spreadsheet cell holds in place of a value.
SPREADSHEET_ERRORS = (
    "#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#N/A", "#NULL!", "#NUM!", "#GETTING_DATA", "#SPILL!", "#CALC!", "#FIELD!", "#BLOCKED!", "#CONNECT!", "#UNKNOWN!",
    "#BUSY!",
)

#: Colloquial words and phrases and their standard form.
COLLOQUIAL_PHRASES = {"قد ايه": "كم", "اد ايه": "كم", "كام يوم": "كم يوما", "اول من امبارح": "اول امس"}

COLLOQUIAL_WORDS = {
    "كام": "كم", "بكام": "بكم", "امتي": "متي", "امتا": "متي", "مين": "من", "ايه": "ما",
    "ايش": "ما", "شو": "ما", "ايشو": "ما", "فين": "اين", "وين": "اين", "ازاي": "كيف",
    "كيفاش": "كيف", "ليه": "لماذا", "ليش": "لماذا", "انهي": "اي", "انهو": "اي", "دلوقتي": "الان",
    "دلوقت": "الان", "الحين": "الان", "هلق": "الان", "امبارح": "امس", "بكره": "غدا", "بكرا": "غدا",
    "عايز": "اريد", "عاوز": "اريد", "عايزه": "اريد", "عاوزه": "اريد", "ابغي": "اريد", "ابغا": "اريد",
    "بدي": "اريد", "اللي": "الذي", "كمان": "ايضا", "برضه": "ايضا", "برضو": "ايضا", "مش": "لا",
    "مو": "لا", "شغل": "اعمال", "الشغل": "الاعمال", "فلوس": "مبالغ", "الفلوس": "المبالغ", "حاجه": "شيء",
    "اتمضي": "وقع", "اتمضت": "وقعت", "اتعمل": "تم", "اتعملت": "تمت", "اتسلم": "استلم", "اتسلمت": "استلمت",
    "اتقدم": "قدم", "اتقدمت": "قدمت", "اترفع": "رفع", "اترفعت": "رفعت", "اتدفع": "دفع", "اتدفعت": "دفعت",
    "اتبني": "بني", "اتبنت": "بنيت", "اتحكم": "حكم", "اتصدر": "صدر", "اتصدرت": "صدرت", "اتهد": "انهار",
    "هتبقي": "ستكون", "هيبقي": "سيكون", "هتكون": "ستكون", "هيكون": "سيكون", "بتبقي": "تكون", "بيبقي": "يكون",
}

#: Words that carry nothing to match.
FILLERS = (
    "بتاع", "بتاعه", "بتاعت", "بتوع", "يعني", "بقي", "كده", "كدا", "طيب", "يا", "ده", "دا", "دي",
)

#: Groups of words that a document may use for one thing.
SYNONYMS = (
    ("عقد", "تعاقد", "اتفاقيه"),
    ("سور", "جدار", "حائط"),
    ("غرامه", "جزاء"),
    ("مبلغ", "قيمه"),
    ("ثمن", "سعر", "تكلفه"),
    ("مقاول", "متعهد"),
    ("مالك", "صاحب"),
    ("موعد", "تاريخ"),
    ("مده", "فتره", "مهله"),
    ("توقيع", "امضاء"),
    ("بدء", "بدايه", "شروع"),
    ("انتهاء", "نهايه"),
    ("انهيار", "سقوط", "انهار", "سقط"),
    ("رخصه", "تصريح"),
    ("شكوي", "بلاغ"),
    ("رسوم", "اتعاب"),
    ("ضمان", "كفاله"),
    ("حفر", "حفريات"),
    ("تسليم", "استلام"),
    ("اخطار", "اشعار", "تبليغ"),
    ("خساره", "ضرر"),
    ("انجاز", "تنفيذ"),
    ("نسبه", "معدل"),
    ("محامي", "وكيل"),
    ("موظف", "عامل"),
    ("اجازه", "عطله"),
    ("جسور", "جسر", "كمرات", "beam", "beams"),
    ("اعمده", "عمود", "column", "columns"),
    ("سقف", "بلاطه خرسانيه", "slab", "slabs"),
    ("قواعد", "اساسات", "footing", "footings", "foundation"),
    ("رقاب الاعمده", "neck column", "neck columns"),
    ("ميده", "ميدات", "ground beam", "tie beam", "tie beams"),
    ("سور", "boundary wall", "compound wall", "fence wall"),
    ("عزل", "insulation", "waterproofing"),
    ("بلاط", "سيراميك", "بورسلين", "tiles", "tiling", "porcelain", "ceramic"),
    ("دهان", "صبغ", "paint", "painting"),
    ("لياسه", "plaster", "plastering"),
    ("طابوق", "بلوك", "block", "blockwork", "blocks"),
    ("حفر", "excavation"),
    ("ردم", "دفان", "backfilling", "back filling"),
    ("خرسانه عاديه", "خرسانه نظافه", "blinding", "pcc"),
    ("مكافحه الرمه", "مكافحه النمل", "anti termite", "termite"),
    ("تكييف", "air conditioning", "hvac"),
    ("كهرباء", "electrical"),
    ("صرف صحي", "drainage", "sewage"),
    ("تمديدات صحيه", "plumbing", "sanitary"),
    ("تغذيه مياه", "water supply"),
    ("حديد تسليح", "reinforcement", "rebar", "steel"),
    ("درج", "سلالم", "stairs", "staircase"),
    ("نوافذ", "شبابيك", "windows"),
    ("ابواب", "doors"),
    ("المنيوم", "aluminium", "aluminum"),
    ("جدول الكميات", "مقايسه", "boq", "bill of quantities"),
    ("امر تغيير", "اوامر تغيير", "variation", "variation order"),
    ("محتجزات", "retention"),
    ("كفاله حسن التنفيذ", "performance bond"),
    ("غرامه تاخير", "delay penalty", "liquidated damages"),
    ("مخطط", "مخططات", "drawing", "drawings"),
    ("مواصفات", "specification", "specifications"),
    ("عرض سعر", "quotation"),
    ("خزان", "tank"),
    ("مضخه", "pump"),
    ("كاميرات", "مراقبه", "cctv", "camera"),
    ("اطفاء الحريق", "مكافحه الحريق", "fire fighting"),
    ("اتصالات", "etisalat", "telephone"),
    ("مالك", "owner", "client"),
    ("مقاول", "contractor"),
    ("استشاري", "consultant"),
)

#: What a message that teaches sounds like, in the order tried, and how sure each kind is.
SIGNALS = {
    "correction": (0.8, ("المعلومة السابقة غير صحيحة", "الاجابة السابقة خاطئة", "الاجابة غير صحيحة", "هذا غير صحيح", "غير صحيح", "خطا", "الصحيح هو", "التصحيح", "صحح", "that is incorrect", "this is wrong", "that is wrong", "the correct value is", "actually it is", "correction",)),
    "rule": (0.75, ("تعلم القاعده", "تعلم القاعدة", "القاعده هي", "من الان فصاعدا", "من الان", "دائما اعرض", "دائما اذكر", "لا تختر", "يجب دائما", "كلما", "learn this rule", "from now on", "always show", "always list", "never choose", "whenever", "as a rule",)),
    "procedure": (0.65, ("الاجراء هو", "الخطوات هي", "اتبع الخطوات", "اولا ثم", "طريقه العمل", "the procedure is", "the steps are", "follow these steps", "the process is",)),
    "terminology": (0.6, ("يقصد ب", "المقصود ب", "نعني ب", "يسمى", "مصطلح", "تعريف", "we mean by", "the term", "is defined as", "refers to", "stands for",)),
    "preference": (0.7, ("افضل", "اريد الاجابه", "اجب باختصار", "اجب بالعربيه", "اجب بالانجليزيه", "اختصر", "بالتفصيل", "اسلوبي", "i prefer", "i'd prefer", "answer briefly", "keep it short", "be concise", "answer in arabic", "answer in english", "in detail",)),
    "fact": (0.55, ("تعلم ان", "احفظ ان", "للعلم", "المعلومه هي", "الاسم الرسمي", "القيمه الصحيحه", "سجل ان", "اعتمد ان", "learn that", "remember that", "note that", "for the record", "the official name is",)),
}

#: Verbs whose progressive and future forms are taken for the plain ones.
COLLOQUIAL_VERBS = (
    "يدفع", "يحدد", "يبدا", "ينتهي", "يحسب", "يسدد", "يقدم", "يصدر", "يطلب", "يحكم", "يستحق", "يبلغ", "يكون", "يتم", "يلزم", "يحق", "يغطي", "يشمل", "يتحمل", "يعمل",
    "يسلم", "يستلم", "يرفع", "يوقع",
)

#: Phrases after which a lesson's claim begins.
LEAD_INS = (
    "الصحيح هو", "القيمه الصحيحه هي", "المعلومه هي", "تعلم القاعده", "تعلم القاعدة", "تعلم ان", "احفظ ان", "سجل ان", "اعتمد ان", "القاعده هي", "الاجراء هو",
    "الخطوات هي", "يقصد ب", "المقصود ب", "نعني ب", "the correct value is", "actually it is", "learn that", "remember that", "note that", "the rule is",
    "the procedure is", "we mean by",
)

#: Number words in normalised spelling. Units, those that state nothing alone, tens and hundreds.
AR_UNITS = {
    "واحد": 1, "واحده": 1, "احد": 1, "احدي": 1, "اثنان": 2, "اثنين": 2, "اثنتان": 2, "اثنتين": 2, "اثنا": 2, "اثنتا": 2, "اثني": 2, "اثنتي": 2, "ثلاث": 3, "ثلاثه": 3,
    "اربع": 4, "اربعه": 4, "خمس": 5, "خمسه": 5, "ست": 6, "سته": 6, "سبع": 7, "سبعه": 7, "ثمان": 8, "ثماني": 8, "ثمانيه": 8, "تسع": 9, "تسعه": 9,
}
AR_WEAK = ("واحد", "واحده", "احد", "احدي", "اثنين", "اثنتين", "اثني", "اثنتي", "اثنا", "اثنتا", "ست", "ثماني")
AR_TENS = {
    "عشرون": 20, "عشرين": 20, "ثلاثون": 30, "ثلاثين": 30, "اربعون": 40, "اربعين": 40, "خمسون": 50, "خمسين": 50, "ستون": 60, "ستين": 60, "سبعون": 70, "سبعين": 70,
    "ثمانون": 80, "ثمانين": 80, "تسعون": 90, "تسعين": 90,
}
AR_HUNDRED = ("ميه", "مايه")
AR_TWO_HUNDRED = ("ميتان", "مايتان", "ميتين", "مايتين")
AR_SCALES = {
    "الف": 1_000, "الفا": 1_000, "الاف": 1_000, "الوف": 1_000, "مليون": 1_000_000, "مليونا": 1_000_000, "ملايين": 1_000_000, "مليار": 1_000_000_000,
    "مليارا": 1_000_000_000, "مليارات": 1_000_000_000,
}
AR_SCALE_DUALS = {"الفان": 2_000, "الفين": 2_000, "مليونان": 2_000_000, "مليونين": 2_000_000, "ملياران": 2_000_000_000, "مليارين": 2_000_000_000}
AR_UNIT_DUALS = (
    "يومان", "يومين", "شهران", "شهرين", "اسبوعان", "اسبوعين", "سنتان", "سنتين", "عامان", "عامين", "ساعتان", "ساعتين", "دقيقتان", "دقيقتين", "مرتان", "مرتين",
)
EN_SMALL = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen",
)
EN_TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
EN_SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
