"""Word lists that the catalog's queries use; any others may be given to the operators."""

HERBS = ("桂枝", "麻黄", "甘草", "生姜", "大枣", "白芍", "附子", "干姜", "人参", "白术", "茯苓", "柴胡", "黄芩", "黄连", "半夏", "大黄", "石膏", "知母", "当归", "细辛", "葛根", "桔梗", "杏仁", "枳实", "厚朴", "泽泻", "猪苓", "阿胶", "龙骨", "牡蛎")
# The six meridians, and words that make a question.
MERIDIANS = ("太阳", "阳明", "少阳", "太阴", "少阴", "厥阴")
ORGANS = ("心", "肝", "脾", "肺", "肾", "胃", "胆", "膀胱", "大肠", "小肠", "三焦")
SYMPTOMS = ("发烫", "发凉", "发干", "发紧", "发麻", "发胀", "怕风", "冒汗", "抽筋", "刺痛", "酸软", "僵硬")
ORAL = ("诸位", "你看", "老话讲", "临床上", "对不对", "懂了吗", "其实", "你们记一下", "换句话说", "讲白一点", "说到这里", "刚才有人问")
NOISE_WORDS = ("版权", "扫一扫", "下载全套", "打赏", "转载", "责任编辑", "群号")
LINE_NOISE = (r"^https?://", r"^\d+$", r"^第 *\d+ *页", r"扫一扫|打赏|转载", r"^责任编辑", r"^Notes by", r"^All rights")
COLLOQUIAL = (("怕风", "恶风"), ("怕冷", "恶寒"), ("发烫", "发热"), ("冒汗", "汗出"), ("小肚子", "少腹"), ("头顶", "巅顶"), ("睡不着", "不寐"), ("拉肚子", "下利"), ("胃里", "心下"), ("抽筋", "转筋"))
CONCEPTS = ("太阳病", "阳明病", "少阳病", "太阴病", "少阴病", "厥阴病", "太阳证", "阳明证", "少阳证", "太阴证", "少阴证", "厥阴证")
QUESTION_WORDS = ("什么是", "解释一下", "解释", "是什么", "请问", "的", "？", "?", "证", "病")
RULES = ((("发烫", "冒汗"), "阳明"), (("怕风", "冒汗"), "太阳"), (("发干", "刺痛"), "少阳"), (("发凉", "酸软"), "少阴"), (("抽筋", "发麻", "僵硬"), "厥阴"))
ASPECTS = (("dose", ("[一二三四五六七八九十两]+[两钱克片]", "量减到")), ("pulse", ("脉",)), ("tongue", ("舌",)), ("diet", ("吃多", "先停")), ("case", ("病历", "来找我")))
# Topics that the knowledge base does not cover.
OUT_OF_SCOPE = (
    "高血压", "糖尿病", "癌症", "肿瘤", "冠心病", "心脏病", "失眠", "抑郁症", "焦虑", "痛风", "风湿", "类风湿", "颈椎病", "腰椎间盘", "骨质增生", "骨质疏松",
    "肝炎", "肝硬化", "肾炎", "肾虚", "前列腺", "湿疹", "荨麻疹", "银屑病", "白癜风", "近视", "白内障", "青光眼", "甲状腺", "乳腺", "子宫", "卵巢",
    "减肥", "美容", "祛痘", "祛斑", "肺癌", "胃癌", "肝癌", "肠癌", "艾滋病", "新冠", "新冠肺炎",
    "电影", "电视剧", "音乐", "游戏", "股票", "基金", "足球", "篮球", "编程", "代码", "美食", "旅游", "天气", "新闻", "明星",
)
#: Foreign words of these tables that count as outside, too.
OUTSIDE_HERE = ("insulin", "keratin", "adrenaline", "electrolyte", "MRI", "DNA", "BMI", "CPR", "ICU")
#: Concepts: name, brief, clauses that define it, clauses that treat it, formulas, keywords.
CONCEPT_TABLE = (
    ("太阳病", "太阳病主表。", (1,), (12, 35), ("按就散",), ("太阳", "脉浮", "怕风")), ("阳明病", "阳明病主里热。", (195,), (223, 208), (), ("阳明", "发烫", "冒汗")), ("少阳病", "少阳病在半表半里。", (263,), (96, 263), (), ("少阳", "发干")),
    ("太阴证", "太阴证属里寒。", (273,), (277,), (), ("太阴", "发凉")), ("少阴证", "少阴证属虚寒。", (281,), (301, 303), (), ("少阴", "发凉", "酸软")), ("厥阴证", "厥阴证寒热错杂。", (326,), (338,), (), ("厥阴", "抽筋")),
    ("太阳", "太阳主表。", (1, 3), (13,), (), ("怕风", "冒汗")), ("阳明", "阳明主里。", (180,), (182,), (), ("发烫",)), ("少阳", "少阳主枢。", (263,), (264,), (), ("发干", "刺痛")), ("少阴", "少阴主虚。", (281,), (282,), (), ("发凉",)), ("厥阴", "厥阴主转。", (326,), (327,), (), ("抽筋", "发麻")),
)
SYMPTOM_VOTES = (
    ("发烫", "阳明"), ("冒汗", "阳明"), ("冒汗", "太阳"), ("怕风", "太阳"), ("恶风", "太阳"), ("恶寒", "太阳"), ("发干", "少阳"), ("刺痛", "少阳"), ("发凉", "少阴"), ("酸软", "少阴"), ("抽筋", "厥阴"), ("转筋", "厥阴"), ("发麻", "厥阴"), ("僵硬", "厥阴"), ("不寐", "少阴"), ("往来寒热", "少阳"),
)
SOFT = ("不寐", "酸软")
ADVICE = (("太阳", "避风，早睡。"), ("阳明", "清淡饮食。"), ("少阳", "少动气。"), ("少阴", "保暖。"))
# What a passage about an organ is about, by its first keyword.
ORGAN_ASPECTS = {
    "心": (("脉", "心主血脉的生理功能和病理表现"), ("神", "心藏神与神志的关系"), ("火", "心在五行属火的理论"), ("夏", "心与夏季养生的关系"), ("舌", "心开窍于舌的理论"), ("汗", "心与汗的关系"), ("肾", "心肾相交的理论"), ("脾", "心脾关系在临床中的意义"), ("肺", "心肺关系在生理病理中的意义"), ("主", "心的主要生理功能")),
    "肝": (("血", "肝藏血的生理功能"), ("魂", "肝藏魂与神志的关系"), ("木", "肝在五行属木的理论"), ("春", "肝与春季养生的关系"), ("目", "肝开窍于目的理论"), ("肾", "肝肾同源的理论"), ("脾", "肝脾关系在临床中的意义"), ("主", "肝的主要生理功能"), ("疏泄", "肝主疏泄的功能和病理")),
    "脾": (("血", "脾统血的生理功能"), ("意", "脾藏意与神志的关系"), ("土", "脾在五行属土的理论"), ("长夏", "脾与长夏养生的关系"), ("口", "脾开窍于口的理论"), ("主", "脾的主要生理功能"), ("运化", "脾主运化的功能和病理"), ("肾", "脾肾关系在临床中的意义"), ("心", "心脾关系在临床中的意义")),
    "肺": (("气", "肺主气的生理功能"), ("魄", "肺藏魄与神志的关系"), ("金", "肺在五行属金的理论"), ("秋", "肺与秋季养生的关系"), ("鼻", "肺开窍于鼻的理论"), ("皮", "肺合皮毛的理论"), ("主", "肺的主要生理功能"), ("肾", "肺肾关系在临床中的意义"), ("通调", "肺通调水道的功能")),
    "肾": (("精", "肾藏精的生理功能"), ("志", "肾藏志与神志的关系"), ("水", "肾在五行属水的理论"), ("冬", "肾与冬季养生的关系"), ("耳", "肾开窍于耳的理论"), ("骨", "肾主骨生髓的理论"), ("主", "肾的主要生理功能"), ("心", "心肾相交的理论"), ("脾", "脾肾关系在临床中的意义"), ("肺", "肺肾关系（金水相生）的理论")),
}
#: Events read as symptoms of a case, and what each may mean.
VOTES = (("click", "buyer"), ("click", "reader"), ("purchase", "buyer"), ("view", "reader"), ("view", "visitor"), ("signup", "member"), ("login", "member"), ("logout", "visitor"), ("error", "trouble"))
QUESTIONS = ((0, "Did you mean to buy?", "buyer"), (1, "Are you a member?", "member"), (2, "Did something fail?", "trouble"), (3, "Are you only reading?", "reader"), (4, "First visit?", "visitor"))
