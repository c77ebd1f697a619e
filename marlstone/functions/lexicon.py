"""Words by which names, relations and denials are told in Chinese texts. Plain lists, in the order in which they count."""

# Types of names and the words that end them; of two types with one ending the first stays.
ENDINGS = {
    "organization": "公司 集团 事务所 研究所 研究院 大学 学院 协会 学会 基金会 博物馆 美术馆 图书馆 医院 银行 部门 委员会 法院 检察院 政府 部委",
    "location": "省 市 区 县 镇 乡 村 街 路 道 巷 广场 公园 山 河 湖 海 岛 半岛 海峡 湾 高原 平原 盆地 沙漠 草原 森林",
    "event": "战争 战役 革命 起义 运动 改革 变法 事件 事变 条约 协议 会议 峰会 展览 博览会 奥运会 世界杯 锦标赛 诉讼 纠纷 侵权 犯罪 诈骗 伤害 事故 灾难 地震 洪水 疫情",
    "work": "楼 塔 桥 寺 庙 宫 殿 城 墙 门 亭 阁 院 馆 堂 坊 纪念碑 纪念堂 陵墓 教堂 清真寺 城堡 宫殿 体育场 剧院 车站 机场",
    "concept": "权 责任 义务 要件 行为 制度 程序 主体 客体 情形 情节 处罚 赔偿 主义 风格 流派 理论 原理 定律 效应 模型 算法 技术 工艺 方法 体系 系统 结构",
    "material": "材料 合金 混凝土 玻璃 钢材",
    "award": "奖 勋章 奖章 荣誉 称号 桂冠 锦标",
    "term": "率 系数 指数 参数 指标 阈值 标准 规范 规程 准则",
}
# Names that stand alone.
NAMES = {
    "organization": "联合国教科文组织 联合国 世界银行 国际货币基金组织 世界卫生组织 北约 欧盟 东盟 世贸组织 国际奥委会",
    "location": "北京 上海 广州 深圳 天津 重庆 成都 杭州 南京 武汉 西安 长沙 苏州 郑州 青岛 大连 厦门 合肥 昆明 贵阳 济南 福州 哈尔滨 沈阳 长春 石家庄 太原 兰州 银川 西宁 乌鲁木齐 呼和浩特 南宁 海口 拉萨 香港 澳门 台北 "
    "中国 美国 英国 法国 德国 日本 韩国 俄罗斯 印度 巴西 澳大利亚 加拿大 意大利 西班牙 墨西哥 埃及 南非 阿根廷 泰国 越南 新加坡 马来西亚 印度尼西亚 菲律宾 新西兰 荷兰 瑞士 瑞典 挪威 丹麦 芬兰 比利时 奥地利 葡萄牙 希腊 土耳其 以色列 伊朗 伊拉克 沙特阿拉伯 阿联酋",
    "time": "春秋 战国 三国 南北朝 民国 近代 现代 当代 古代 中世纪 文艺复兴 工业革命 一战 二战 冷战",
    "material": "钢筋混凝土 预制混凝土 碳纤维 不锈钢 耐候钢 钛合金 铝合金 玻璃幕墙 清水混凝土",
    "term": "轻微伤 轻伤 重伤",
}
# What a person's name stands before.
PERSONS = "教授 博士 先生 女士 院士 大师 工程师 建筑师 设计师 艺术家 画家 音乐家 作家 诗人 导演 演员 歌手 科学家 发明家 将军 元帅 皇帝 国王 总统 首相 总理 大臣"
# Relations and the verbs that say them.
RELATIONS = {
    "located_in": "位于 地处 坐落于 坐落", "belongs_to": "属于 隶属于 隶属 归属于 归属", "defined_by": "依据 根据 依照", "includes": "包含 包括 含有", "applies_to": "适用于 适用",
    "punishes": "处罚 惩处 惩治", "requires": "要求 需要 必须具备 须具备", "causes": "导致 引起 造成", "derives_from": "衍生自 源自 来源于", "competes_with": "竞合", "restricts": "限制 约束",
    "constitutes": "构成", "bears": "承担", "protects": "保护", "has_type": "分为 分作", "distinguishes": "区分 区别于 不同于", "designed": "设计", "created": "建造 建设 修建 兴建", "uses": "使用 采用 运用",
    "represents": "代表 象征", "influences": "影响 作用于", "supports": "支持 支撑", "depends_on": "依赖 取决于", "implements": "实现 实行", "precedes": "先于", "works_for": "工作于 就职于 任职于", "employed_by": "受雇于 被聘于",
    "managed_by": "管理 管辖 领导", "owned_by": "拥有 所有", "responsible_for": "负责 主管", "invests_in": "投资 注资", "cooperates_with": "合作 协作", "conquered": "战胜 征服 击败", "allied_with": "结盟 联盟", "prescribes": "规定",
    "prohibits": "禁止 严禁 不许", "permits": "允许 准许 许可", "completed_in": "建成于 竣工于 完成于", "awarded": "获得 荣获 斩获", "covers": "覆盖 涵盖", "transforms_to": "转化为 变为 演变为", "evolves_into": "进化为 演化为",
    "splits_into": "分裂为", "merges_into": "合并为", "migrates_to": "迁移到 迁至", "cites": "引用 援引", "defines": "定义 界定", "explains": "解释 阐释 说明", "prevents": "阻止 防止", "facilitates": "促成 促进 推动",
    "triggers": "引发 触发", "excludes": "排除", "classifies": "分类 归类", "controls": "控制 掌控", "produces": "产生 产出", "changes": "改变 转变", "connected_to": "连接 相连 连通", "adjacent_to": "邻近 毗邻 靠近",
    "similar_to": "相似于 类似于", "superior_to": "优于 胜过", "opposes": "对立 反对", "compatible_with": "兼容 相容", "conflicts_with": "冲突 矛盾", "listed_as": "被列为 列入", "started_at": "起始于 始于 开端于",
    "ended_at": "终止于 终于 结束于", "lasted": "持续 延续了", "occurred_at": "发生于 发生在", "manifests_as": "表现为 体现为", "executes": "执行 实施", "inputs": "输入 接收", "outputs": "输出", "confirms": "证实 确认",
    "questions": "质疑 怀疑", "evaluates": "评价 评估", "prefers": "偏好 倾向于", "corresponds_to": "对应 相应于", "maps_to": "映射", "grows_into": "生长为 成长为", "declines_to": "衰退为 衰落为", "refers_to": "指代 指称",
    "translates_to": "翻译为 译为", "source_of": "来自", "constrains": "制约", "attached_to": "依附于 依附 附着 附属", "inferior_to": "劣于 不及", "succeeded_by": "后继于 继任于", "authorized_by": "授权 委托",
    "acquired_by": "被收购 被并购", "interrupted_by": "被中断 被打断", "resumed_by": "恢复", "trusts": "信任 信赖", "recommends": "推荐 举荐", "dislikes": "不喜欢 厌恶",
}
# What 由 before the one who does it, and a verb behind, say.
AGENTS = {"designed_by": "设计 建造 创建 发明 发现 担任 主持", "composed_of": "组成 构成", "made_of": "材料 材质"}
# Verbs that say an attribute of a known thing, and what the second side must end with, if anything.
ATTRIBUTES = [
    ("has_feature", "包括 包含 具有 拥有 具备", ""),
    ("type_of", "是 为 属于", "技术 模式 方法 体系 系统 平台 框架 架构"),
    ("has_attribute", "的", "技术 能力 功能 特征 要素 组成部分"),
    ("composed_of", "由 由其", "组成 构成 包含"),
    ("includes", "分为 划分 分成", ""),
    ("has_capability", "的应用是 的用途是 的作用是 的目的是 的应用包括 的用途包括 的作用包括 的目的包括 的应用为 的用途为 的作用为 的目的为", ""),
    ("depends_on", "依赖 依托 基于 借助", ""),
    ("facilitates", "推动 促进 带动 引领", "发展 增长 进步 创新"),
    ("supports", "提供 支撑 赋能 服务", ""),
]
# What a thing with features ends with, and what an attribute's own name begins with.
FEATURED = "技术 能力 功能 特性 特征 属性 优势 特点"
WEIGHTY = "核心 关键 重要 主要 基础 基本"
# Words that deny what follows, and the relations that have a name of their own when denied.
DENIALS = "尚不 并不 不 尚未 并未 未 没有 无法 并非 非 不得 不会 不能"
DENIED = {"constitutes": "not_constitutes", "belongs_to": "excludes"}
# No names.
NO_NAMES = "尚 不 的 了 是 在 有 和 与 或 及 等 为 被 将 把 从 向 对 按 以 于 到 由 其 此 该 中 上 下 可 能 会 需 须 应 当 也 又 且 但 而 则 却 虽 若 如 因 故 即 还 更 最 很 已 曾 正 着 不构成 不属于 不足以 尚不 针对 其中 属于 构成 承担 保护 适用 处罚 要求 关联 关系 规则 体系 这个 那个 一个 一种 以及 可以 需要 进行 他们 我们"
# Whose age a text may tell, and what lists in brackets may be of.
AGED = "犯罪主体 主体 自然人 建筑师 设计师 工程师 申请人 候选人 参与者"
LISTED = "处罚种类 承担责任方式 侵权客体 核心约束 伤情 数额 建筑风格 结构类型 材料种类 奖项类别 技术指标 功能分区 设计理念 影响因素 组成部分 关键参数"
