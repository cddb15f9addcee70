"""Lexicons. Every operator takes its words as a parameter; these are ready-made sets.

Fixed values follow: they must be as they are for right results on Chinese content.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: relevance, categories, importance -------------------------------------
FOCUS = (
    "高考", "高三", "普通高考", "新高考", "志愿", "志愿填报", "本科", "专科", "高校", "大学", "院校", "专业", "招生", "录取",
    "分数线", "投档线", "位次", "一分一段", "提前批", "强基", "强基计划", "综合评价", "综评", "选科", "首选科目", "再选科目",
    "学业水平", "合格考", "等级考", "一模", "二模", "三模", "保送", "艺考", "体育单招", "港澳升学", "中外合作办学", "高中升学", "升学规划",
)
ADMISSION = (
    "招生简章", "本科招生", "普通本科招生", "高校招生", "大学招生", "院校招生", "招生章程", "招生计划", "招生专业", "选科要求",
    "专业组", "院校专业组", "综合评价招生", "综合评价录取", "强基计划招生", "强基计划报名", "中外合作", "中外合作办学", "国际本科",
    "港澳高校", "香港高校", "澳门高校", "内地招生", "专项计划", "高校专项", "地方专项", "国家专项", "保送生", "少年班", "丘成桐",
    "拔尖计划", "双一流", "985", "211",
)
CONTEXT = ("高中", "普通高中", "江苏省", "常州", "全国", "考生", "家长", "报名", "考试", "政策", "办法", "通知", "公告", "公示")
LOW_SIGNAL = ("教育", "学校", "学生", "教师", "校长", "课堂", "教研", "培训", "会议")
NOISE = (
    "食堂", "供餐", "安保", "反恐", "消防", "安全演练", "培训会", "工作培训", "党建", "工会", "慰问", "招聘", "采购", "招标",
    "课后服务", "双减", "幼儿园", "幼升小", "小升初", "中考", "中招", "职教高考", "中职", "职高", "考研", "留学",
)
RESCUE = ("高考", "志愿", "录取", "本科", "专科", "强基", "综评", "综合评价", "中外合作", "招生简章", "高校招生", "大学招生", "港澳高校")
CATEGORIES = (
    ("小升初", ("小升初",)),
    ("初升高", ("初升高", "中考", "中招", "升高中", "指标生", "中考成绩", "中考分数线", "中考录取", "普高")),
    ("高考", ("高考", "高三", "普通高考", "高考成绩", "高考分数线", "高考录取", "高考志愿")),
    ("政策文件", ("政策", "文件", "办法", "规定", "实施意见", "细则", "条例")),
    ("校园公告", ("通知", "公告", "通报", "公示")),
    ("招生录取", ("招生", "录取", "报名", "志愿填报", "入学")),
    ("学区划片", ("学区", "划片", "对口", "施教区")),
    ("考试测评", ("考试", "统考", "模考", "调研", "学业质量")),
    ("学科竞赛", ("竞赛", "比赛", "奥赛", "白名单")),
    ("校园开放日", ("开放日", "校园开放", "探校")),
    ("升学规划", ("升学", "考研", "留学", "转学", "幼升小", "国际学校", "升学规划", "综评", "强基计划", "中外合作办学", "港澳升学", "保送")),
)
OTHER_CATEGORY = "媒体"
IMPORTANCE = (("重大", ("学区调整", "招生政策", "录取", "考试安排")), ("重要", ("开放日", "竞赛", "通知", "排名")))
OTHER_IMPORTANCE = "普通"
MATERIAL_KEYWORDS = ("常州", "中考", "升学", "招生", "政策", "学校", "家长", "学区", "考试", "开放日", "高校", "专业", "就业", "录取")
PROFILE_PHRASES = {
    "core_views": ("择校", "升学", "政策", "中考", "学区", "民办"),
    "style_traits": ("直接", "清单", "误区", "建议", "案例", "提醒"),
    "common_topics": ("常州", "学校", "招生", "考试", "家长", "录取"),
    "parent_questions": ("怎么选", "要不要", "怎么办", "能不能", "适合谁"),
}
DISCOVERY = ("高考", "升学", "志愿填报", "专业选择", "强基计划", "综评", "选科", "录取", "规划")
DISCOVERY_EXCLUDED = ("中考", "中职", "职高", "小升初", "幼升小", "留学", "考研", "专升本")
THRESHOLDS = (("抖音", "全国大博主", 1250, 500), ("微信视频号", "全国大博主", 250, 50), ("抖音", "常州本地", 125, 50), ("微信视频号", "常州本地", 50, 18))
SOURCE_NAMES = (
    ("jyj.changzhou.gov.cn", "常州市教育局"), ("www.cz001.com.cn", "中吴网"), ("cz.bendibao.com", "常州本地宝"),
    ("www.hualongxiang.com", "化龙巷"), ("changzhou.bendibao.com", "常州本地宝"),
)
TITLE_TAILS = ("更多", "详情", "全文", "点击查看")
# --- Fixed values: transcripts -------------------------------------------------------------
LYRIC_MARKERS = ("原唱", "歌词", "伴奏", "编曲", "作曲", "作词", "演唱", "翻唱", "钢琴版", "吉他版", "小提琴版", "纯音乐", " instrumental")
SPEECH_WORDS = (
    "高考", "志愿", "填报", "专业", "院校", "大学", "本科", "专科", "录取", "分数", "位次", "投档", "招生", "选科", "强基", "综评",
    "考生", "家长", "就业", "保研", "学科", "学校", "批次", "提前批", "滑档", "退档",
)
LYRIC_WORDS = ("爱", "心", "梦", "远方", "星光", "月光", "花开", "孤独", "眼泪", "思念", "拥抱", "天空", "风雨", "青春", "离开", "回来", "等待")
FILLERS = (
    "大家好", "嗯+哼?", "呃+", "啊+", "呀+", "哎+", "唉+", "额+", "哦+", "噢+", "喔+", "哈+", "嘛+", "呐+", "嗨+", "呢+", "呗+", "哟+",
    "咦+", "咳+", "这个", "那个", "这些", "那些", "就是说", "就是", "然后", "其实", "那么", "所以说", "你知道", "你知道吧", "对吧",
    "是不是", "对不对", "怎么说呢", "咱们", "我跟你讲", "我跟你说", "说白了", "也就是说", "换句话说", "简单来说", "总的来说", "等一下",
    "稍等", "那个啥", "这个嘛", "的话",
)
REPEATED_FILLERS = "嗯啊呃额哦噢喔哈哎唉呀嘛呢呐呗哟咦咳"
BREAKS = (
    "然后", "接着", "另外", "此外", "还有", "总之", "所以", "因此", "最后", "比如", "例如", "再说", "接下来", "首先", "其次",
    "第一", "第二", "第三", "第四", "第五",
)
PARTICLES = ("的", "了", "是", "和", "与", "，")
QUESTIONS = ("什么", "怎么", "如何", "哪", "谁", "为什么", "是否", "能否", "多少", "几", "怎样", "何", "咋")
# --- Fixed values: article distillation -----------------------------------------------------
DOMAIN = (
    "升学", "规划", "志愿", "填报", "录取", "分数", "位次", "专业", "院校", "大学", "高考", "中考", "选科", "招生", "批次", "投档",
    "强基", "综评", "自主招生", "就业", "考研", "保研", "学科", "赋分", "等级", "省控线", "一分一段", "家长", "学生", "孩子", "考生",
    "政策", "改革", "新规", "学区", "分流",
)
NOISE_PHRASES = (
    r"点击(上方|下方)?[^，。\n]{0,12}关注", r"长按(识别|扫描)[^，。\n]{0,20}", r"扫码(添加|关注|咨询)[^，。\n]{0,20}",
    r"(本文|素材|图片)?(来源|转载自)[:：][^，。\n]{0,30}", r"侵(权|删)[^，。\n]{0,20}", r"免责声明[^，。\n]{0,40}",
    r"版权归[^，。\n]{0,30}所有", r"欢迎(转发|分享|留言)[^，。\n]{0,20}", r"(点个|点击)(在看|赞|关注)[^，。\n]{0,15}",
    r"更多(资讯|信息|内容)[^，。\n]{0,20}", r"加(小助手|老师|微信)[^，。\n]{0,20}", r"咨询电话[:：]?[\d\-\s]{6,}", r"[（(]?文末[^，。\n]{0,20}[)）]?",
)
PROMOTION = (
    r"是一家(专注|致力|专业)", r"有限公司|股份公司|集团有限", r"(成立于|发起成立|创立于)", r"战略合作(伙伴)?关系", r"旨在(帮助|为|打造)",
    r"依托[^，。]{0,20}(资源|平台|优势)", r"(我们|本公司|本机构|本中心)(是|提供|拥有)", r"官方(微信|公众号|网站)",
    r"(报名|咨询|加盟|合作)(热线|方式|请联系)", r"(专业平台|服务平台|研究中心)(作为|是)", r"提供最新政策解读",
)
CHAPTERS = ("不同的阶段", "做好升学规划", "提到升学规划", "怎么做升学规划")
DATA_PATTERN = r"[0-9]+(\.[0-9]+)?\s*(%|％|分|名|位|人|万|亿|所|个|年|届|倍|元|천)|第\s*[0-9]+\s*(名|位|批)|[0-9]{4}\s*年"
CASE_PATTERN = "例如|比如|举例|案例|譬如|以.{2,10}为例|有位|有个|某同学|某学生"
WE = "^我们"
REWRITES = (
    ("小编", "我们"), ("本号", "该账号"), ("关注我们", "持续关注"),
    ("大多数人第一反应是", "不少家长的第一反应是"), ("其实(是)?", "事实上"), ("我们(认为|觉得)", "我们的判断是"), ("你(知道|以为)", "家长常以为"),
    ("最大的误解", "一个普遍的认知偏差"), ("非常重要", "具有决定性影响"), ("很重要", "不容忽视"), ("需要注意", "值得重点关注"),
    ("总之", "综合来看"), ("因此", "由此"), ("所以", "因而"), ("但是", "然而"), ("如果", "若"), ("很多", "不少"), ("孩子们", "学生"),
    ("家长们", "家长"), ("最好", "建议优先"), ("应该", "通常应当"), ("可以", "可考虑"),
)
CAUTION = r"预计|或将|有望|可能|拟|草案|征求意见|计划于|未来|新规|改革|调整|变动|据传|网传|业内预测|有望在|据透露|传闻|疑似|20[0-9]{2}\s?年?"
PERSONS = ("同学", "学生", "家长")
# --- End of fixed values --------------------------------------------------------------------


@dataclass(frozen=True)
class Relevance:
    """Weighted word sets, noise and what rescues a text that has noise."""

    weighted: tuple[tuple[tuple[str, ...], int], ...] = ((FOCUS, 12), (ADMISSION, 18), (CONTEXT, 3), (LOW_SIGNAL, 1), (NOISE, -18))
    noise: tuple[str, ...] = NOISE
    rescue: tuple[str, ...] = RESCUE
    least: int = 12


@dataclass(frozen=True)
class Speech:
    """Words that the transcript operators use."""

    markers: tuple[str, ...] = LYRIC_MARKERS
    domain: tuple[str, ...] = SPEECH_WORDS
    lyric: tuple[str, ...] = LYRIC_WORDS
    fillers: tuple[str, ...] = FILLERS
    repeated: str = REPEATED_FILLERS
    letters: str = "一-鿿"
    ends: str = "。！？；"
    breaks: tuple[str, ...] = field(default=BREAKS)
