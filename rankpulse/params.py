"""Parameters: word lists, thresholds and maps. Every operator takes its own as an argument with these as defaults."""

# Lists and numbers that results depend on.

TRACK_WORDS = (
    "塔防", "肉鸽", "割草", "TD", "Tower Defense", "tower defense", "Roguelike", "roguelike", "Roguelite", "roguelite",
    "Vampire Survivors", "Survivors-like", "王国保卫战", "Kingdom Rush", "保卫萝卜", "Dungeon Defense", "地牢防御",
)
IGNORED_WORDS = (
    "女性向", "二次元", "乙女", "恋与深空", "恋与制作人", "光与夜之恋", "闪耀暖暖", "奇迹暖暖", "无限暖暖", "未定事件簿",
    "时空中的绘旅人", "世界之外", "恋与",
)
PRODUCT_WORDS = (
    "联动", "上线", "更新", "公测", "内测", "发售", "开服", "新角色", "新版本", "新活动", "限定", "复刻", "周年庆", "新赛季", "新地图",
    "新玩法", "改版", "重制", "移植", "下架", "停服", "关服", "发布", "推出", "曝光", "预告", "首曝", "下载", "预约", "预购", "Steam",
    "steam", "手游", "iOS", "Android", "安卓", "苹果",
)
BLOCK_WORDS = (
    "AirPods", "iPhone", "iPad", "MacBook", "Apple Watch", "电动滑板车", "电视", "耳机", "音箱", "手表", "Prime Day", "特惠精选", "世界杯",
    "足球", "NBA", "英超", "西甲", "欧冠", "演唱会", "张靓颖", "明星", "八卦", "走光", "抄袭", "芝麻街", "Netflix", "电影", "预告", "剧透",
    "礼包", "广告", "赛马大会", "抢号", "Alienware", "ROG新品", "游戏电脑", "大促", "立省", "史低", "新史低", "平史低", "白菜价", "白嫖", "喜加",
    "夏促", "冬促", "春促", "秋促", "打折", "促销", "免费领", "限免", "免费玩", "捆绑包", "折扣推荐", "史低推荐", "音游", "节奏游戏", "Steam新品节",
    "游戏节",
)
VIDEO_BLOCK_WORDS = (
    "史低", "新史低", "平史低", "白菜价", "白嫖", "喜加", "夏促", "冬促", "春促", "秋促", "打折", "促销", "免费领", "限免", "免费玩", "捆绑包", "折扣推荐",
    "史低推荐", "电竞", "夺冠", "决赛", "赛事", "Major", "major", "CS2", "CS:GO", "CSGO", "NiKo", "Falcons", "猎鹰", "音游", "节奏游戏",
)
COMPANIES = (
    "腾讯", "网易", "米哈游", "字节跳动", "莉莉丝", "叠纸", "鹰角", "完美世界", "三七互娱", "索尼", "任天堂", "微软", "Steam", "Playtika",
    "Tencent", "NetEase", "miHoYo", "Garena", "育碧", "EA", "暴雪", "Riot", "Embracer", "Take-Two", "Nexon", "Netmarble", "Krafton",
    "Pearl Abyss", "凉屋", "祖龙", "快手", "B站", "哔哩哔哩",
)
ENTITY_COMPANIES = ("腾讯", "网易", "米哈游", "字节跳动", "莉莉丝", "叠纸", "鹰角", "完美世界", "三七互娱", "索尼", "任天堂", "微软")
TREND_WORDS = ("二游", "二次元", "乙女")
KNOWN_GAMES = (
    "原神", "崩坏", "星穹铁道", "绝区零", "明日方舟", "碧蓝航线", "少女前线", "FGO", "Fate/Grand Order", "阴阳师", "白夜极光", "鸣潮", "蔚蓝档案",
    "赛马娘", "公主连结", "崩坏3", "未定事件簿", "世界计划", "学园偶像祭", "BanG Dream", "Love Live", "王者荣耀", "和平精英", "蛋仔派对", "无限暖暖",
    "恋与深空", "重返未来", "光遇", "第五人格", "梦幻西游", "英雄联盟", "LOL", "DNF", "CF", "逆水寒", "永劫无间", "幻塔", "尘白禁区",
)
GAMING_SIGNALS = (
    "游戏", "手游", "网游", "页游", "主机", "端游", "Steam", "Epic", "Xbox", "PlayStation", "PS5", "Switch", "NS版", "PC版", "Xbox版", "电竞", "战队",
    "上线", "公测", "内测", "开服", "版本更新", "资料片", "DLC", "销量", "评分", "评分解禁", "M站", "开发商", "发行商", "工作室", "新作", "续作", "重制版",
    "重制", "移植", "复刻", "试玩", "Demo", "预告", "发售", "预售", "预购", "国区", "低价区", "卡普空", "任天堂", "索尼", "微软", "SE", "万代", "暴雪",
    "EA", "育碧", "R星", "CDPR", "米哈游", "腾讯", "网易", "JRPG", "RPG", "FPS", "MOBA", "RTS", "开放世界", "魂系", "肉鸽", "Roguelike", "Mod", "汉化",
    "补丁", "显卡", "驱动", "帧数", "光追",
)
FOREIGN_CONTEXT = (
    "世界杯", "足球", "篮球", "球迷", "球王", "破门", "逼平", "歌手", "清唱", "抄袭", "绯闻", "出轨", "恋情", "股票", "涨停", "跌停", "基金经理",
    "安室奈美惠", "张靓颖", "单依纯",
)
FATIGUE_NOISE = ("游戏", "资讯", "新闻", "今日", "最新", "推荐")
STORY_NOISE = (
    "报告", "报道", "文章", "分析", "认为", "表示", "指出", "显示", "该新闻", "反映了", "目前", "已经", "可以", "进行", "这个", "通过", "以及", "包括",
    "对于", "根据", "作为", "不仅", "游戏", "新闻", "近日", "本周", "资讯", "了解", "据悉", "the", "and", "for", "this", "that", "with", "from", "game",
    "news", "report", "reports", "reported", "says", "said",
)
QUESTION_WORDS = ("如何", "怎么看", "为什么", "是否", "怎么")
QUESTION_URLS = ("/question/",)
ARTICLE_URLS = ("/p/", "/zvideo/")
ENTITY_STOP = (
    "The", "And", "For", "From", "With", "Japanese", "Game", "Games", "New", "Best", "Top", "Mobile", "Latest", "Report", "Studio",
    "Industry", "Market", "Global", "World", "First", "Major", "Next", "Big", "Future", "More", "Most", "Year", "Week", "Day", "News",
    "Weekly", "Daily",
)
FRESH_MARKS = (("今日", "今日"), ("今天", "今日"), ("今晚", "今日"), ("昨日", "昨日"), ("昨天", "昨日"), ("本周", "本周"), ("这周", "本周"), ("上周", "上周"), ("本月", "本月"), ("上月", "上月"))
DIGEST_WORDS = ("周报", "汇总", "盘点", "总结", "周榜", "月报", "Weekly", "Roundup", "Digest")
POS_LABELS = ("track_direct", "playable_reference", "ai_related", "high_info_density", "exclusive_scoop", "overseas_insight")
NEG_LABELS = ("no_gameplay", "digest_rerun", "off_track", "low_info", "stale", "generic_pr")
CLEAR_POS_LABELS = ("track_direct", "high_info_density", "exclusive_scoop", "overseas_insight")
CLEAR_NEG_LABELS = ("off_track", "no_gameplay", "low_info", "stale")
TITLE_PREFIXES = ("游戏资讯", "行业活动", "行业分析", "[B站", "资讯")
NOISE_WORDS = ("steam", "game", "play", "pc", "app")
CURATED_KEYWORDS = ("游戏公司 融资 并购", "新游 测试 上线", "游戏版号 审核", "腾讯 网易 米哈游 游戏", "工作室 合作 裁员 游戏")
RELEVANT_WORDS = (
    "游戏", "电竞", "手游", "端游", "主机", "Steam", "Epic", "Unreal", "Unity", "引擎", "版号", "审核", "审批", "腾讯", "网易", "米哈游",
    "育碧", "任天堂", "索尼", "微软", "Xbox", "PlayStation", "Nintendo", "GDC", "E3", "TGA", "AI", "人工智能", "GPU", "显卡", "芯片", "硬件",
    "独立游戏", "3A", "开放世界", "RPG", "FPS", "MOBA", "赛事", "战队", "直播",
)
IRRELEVANT_WORDS = (
    "股票", "基金", "楼市", "房价", "比特币", "NFT", "综艺", "电视剧", "电影票房", "明星", "绯闻", "足球", "篮球", "NBA", "世界杯", "奥运会",
    "疫情", "地震", "台风",
)
RECRUITING_WORDS = ("offer", "hiring", "job", "recruit", "campus", "intern", "校招", "社招", "求职", "招聘", "招人", "岗位", "简历", "面试")
LOW_VALUE_WORDS = ("geo", "seo", "etf", "证券", "基金", "股价", "快讯", "高考", "冲突", "单车", "投影仪", "耳机", "显卡", "手机", "攻略", "开箱", "测评", "优惠")
PLATFORM_WORDS = ("steam", "taptap", "ai", "aigc", "npc", "gdc")
BUSINESS_WORDS = (
    "版号", "审核", "审批", "上线", "公测", "内测", "测试", "财报", "并购", "收购", "融资", "投资", "合作", "工作室", "裁员", "发行", "代理", "出海",
    "买量", "流水", "引擎", "平台", "腾讯", "网易", "米哈游", "莉莉丝", "鹰角", "心动", "叠纸", "三七互娱", "世纪华通", "完美世界",
)
HOT_TRACK_WORDS = ("塔防", "肉鸽", "Roguelike", "roguelike", "割草")
SOURCE_ALIASES = {
    "3dm": "3DM", "3dmgame": "3DM", "youxituoluo": "游戏陀螺", "yxrb": "游戏日报", "gamelook": "GameLook", "pocketgamer": "pocketgamer.biz",
    "pg.biz": "pocketgamer.biz", "bilibili.com": "Bilibili", "b站": "Bilibili",
}
REMOVED_SOURCES = ("gamersky", "游侠", "游侠资讯", "ali213")
SOURCE_ORDER = {"游戏陀螺": 0, "GameLook": 1, "游戏日报": 2, "17173": 3, "3DM": 4, "pocketgamer.biz": 5, "Bilibili": 6}
SOURCE_WEIGHT = {"17173": 45, "3DM": 30, "游戏陀螺": 50, "游戏日报": 35, "GameLook": 40, "pocketgamer.biz": 35, "Bilibili": 25}
SOURCE_LABEL = {"pocketgamer.biz": "PG.biz", "Bilibili": "B站"}
DOMESTIC_SOURCES = ("17173", "3DM", "游戏陀螺", "游戏日报", "GameLook")
STORY_BASE = {"big_jump": 100, "black_horse": 95, "cliff_drop": 90, "steady_climber": 80, "cluster_move": 70}
