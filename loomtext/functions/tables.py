"""Fixed values of the text engine."""

from __future__ import annotations

import unicodedata

# ---- fixed values: delimiters that end a segment -------------------------------------------------
DELIMITERS = " \t\n\r!\"#$%&'()*+,-./:;<=>?@[\\]^_{}|~＝、。﹁﹂—－（）《》〈〉？！…／＼︒︑︔︓︿﹀︹︺︙︐［﹇］﹈︕︖︰︳︴︽︾︵︶｛︷｝︸﹃﹄【︻】︼　～．，；："

# ---- fixed values: small dictionaries, "key value" in file order ---------------------------------
ST_PUNCTUATIONS = "“ 「|” 」|‘ 『|’ 』"
TS_PUNCTUATIONS = "「 “|」 ”|『 ‘|』 ’"
TW_VARIANTS = (
    "僞 偽|啓 啟|喫 吃|嫺 嫻|嬀 媯|峯 峰|幺 么|梁 梁|擡 抬|棱 稜|樑 梁|檐 簷|污 汙|泄 洩|潙 溈|潨 潀|爲 為|牀 床|痹 痺|癡 痴|皁 皂|着 著|睾 睪|祕 秘|竈 灶|糉 粽|繮 韁|纔 才|羣 群|"
    "脣 唇|蔘 參|蔿 蒍|衆 眾|裏 裡|覈 核|踊 踴|鉢 缽|鍼 針|鮎 鯰|麪 麵|麼 麼|齶 顎|偽 偽|吃 吃|啟 啟|媯 媯|嫻 嫻|峰 峰|才 才|抬 抬|核 核|溈 溈|潀 潀|灶 灶|為 為|煙 煙|痴 痴|皂 皂|眾 眾|稜 稜|"
    "群 群|艷 艷|著 著|蒍 蒍|裡 裡|針 針|麵 麵"
)
TW_VARIANTS_REV = (
    "偽 偽|啟 啟|吃 吃|嫻 嫻|媯 媯|峰 峰|么 幺|梁 梁|抬 抬|稜 稜|樑 樑|簷 檐|汙 污|洩 泄|溈 溈|潀 潀|為 為|床 牀|痺 痹|痴 痴|皂 皂|著 著|睪 睾|秘 祕|灶 灶|粽 糉|韁 繮|才 才|群 群|唇 脣|參 蔘|"
    "蒍 蒍|眾 眾|裡 裡|核 核|踴 踊|缽 鉢|針 針|鯰 鮎|麵 麵|麼 麼|顎 齶|煙 煙|艷 艷"
)
TW_VARIANTS_PHRASES = "喫茶小舖|張棟樑|林國樑|林杰樑|楊士樑|牛驥同一皁|牛驥同皁|純喫茶|羅興樑|葉步樑|蔣國樑|黃東樑"  # each stays as it is
HK_VARIANTS = (
    "僞 偽|兌 兑|叄 叁|只 只|啓 啓|喫 吃|囪 囱|妝 妝|媼 媪|嬀 媯|悅 悦|慍 愠|戶 户|才 才|挩 捝|搵 揾|擡 抬|敓 敚|敘 敍|柺 枴|核 核|梲 棁|棱 稜|榲 榅|檯 枱|氳 氲|涗 涚|溫 温|溼 濕|潙 溈|潨 潀|煙 煙|"
    "熅 煴|爲 為|癡 痴|皁 皂|祕 秘|稅 税|竈 灶|糉 粽|線 線|縕 緼|纔 才|脣 唇|脫 脱|膃 腽|臥 卧|臺 台|菸 煙|蒕 蒀|蔥 葱|蔿 蒍|蘊 藴|蛻 蜕|衆 眾|衛 衞|覈 核|說 説|踊 踴|轀 輼|醞 醖|鉢 缽|鉤 鈎|銳 鋭|"
    "鍼 針|閱 閲|鰮 鰛|吃 吃|抬 抬|灶 灶|痴 痴|皂 皂|眾 眾|稜 稜|艷 艷|著 著|裏 裡|裡 裡|針 針"
)
HK_VARIANTS_REV = (
    "偽 僞|兑 兌|叁 叄|只 只|衹 只|啓 啓|啟 啓|吃 吃|囱 囪|妝 妝|粧 妝|媪 媼|媯 嬀|悦 悅|愠 慍|户 戶|才 才|捝 挩|揾 搵|抬 抬|敚 敓|敍 敘|敘 敘|枴 柺|核 核|棁 梲|稜 稜|棱 棱|榅 榲|枱 檯|氲 氳|涚 涗|"
    "温 溫|濕 溼|溈 潙|潀 潨|煙 煙|煴 熅|為 爲|痴 痴|皂 皂|秘 祕|税 稅|灶 灶|粽 糉|糉 糉|糭 糉|線 線|綫 線|緼 縕|纔 纔|唇 脣|脱 脫|腽 膃|卧 臥|台 臺|菸 菸|蒀 蒕|葱 蔥|蒍 蔿|藴 蘊|蜕 蛻|眾 眾|衞 衛|"
    "覈 覈|説 說|踴 踊|輼 轀|醖 醞|缽 鉢|鈎 鉤|鋭 銳|針 針|閲 閱|鰛 鰮|艷 艷|著 著|裡 裡"
)
HK_PHRASES = (
    "丹尼·博伊爾 丹尼·波爾|亞歷杭德羅·岡薩雷斯·伊納裏圖 艾力謝路·高沙里斯·依拿力圖|伊利亞·卡贊 伊力·卡山|伊利諾伊 伊利諾|伊利諾伊州 伊利諾州|伍迪·艾倫 活地·亞倫|俄克拉何馬 奧克拉荷馬|俄克拉何馬州 奧克拉荷馬州|"
    "俄克拉荷馬 奧克拉荷馬|俄克拉荷馬州 奧克拉荷馬州|保羅·哈吉斯 保羅·夏傑斯|保羅·托馬斯·安德森 保羅·湯馬士·安德遜|光標 游標|克林特·伊斯特伍德 奇連·伊士活|克里斯托弗·諾蘭 基斯杜化·路蘭|內存條 記憶體模組|"
    "凱文·科斯特納 奇雲·高士拿|凱瑟琳·畢格羅 嘉芙蓮·碧格露|北卡羅來納 北卡羅萊納|北卡羅來納州 北卡羅萊納州|南卡羅來納 南卡羅萊納|南卡羅來納州 南卡羅萊納州|史蒂夫·麥奎因 史提夫·麥昆|吉列爾莫·德爾托羅 古利姆·迪托路|"
    "喬治·克魯尼 佐治·古尼|大衛·利恩 大衛·連|奧利弗·斯通 奧利華·史東|威廉·弗萊德金 威廉·佛烈金|密歇根 密芝根|密歇根州 密芝根州|寬帶 寬頻|山姆·曼德斯 森·曼特斯|布拉德·皮特 畢·彼特|幾率 機率|弗吉尼亞 維珍尼亞|"
    "弗吉尼亞州 維珍尼亞州|弗朗西絲·麥克多曼德 法蘭絲·麥杜雯|彼得·傑克遜 彼德·積遜|得克薩斯 德薩斯|得克薩斯州 德薩斯州|德克薩斯 德薩斯|德克薩斯州 德薩斯州|搜索 搜尋|操作系統 作業系統|文件夾 資料夾|"
    "斯蒂芬·斯皮爾伯格 史提芬·史匹堡|服務器 伺服器|朗·霍華德 朗·侯活|本·阿弗萊克 賓·艾佛力|查爾斯·羅文 查理士·路雲|梅爾·吉布森 米路·吉遜|概率 概率|沃倫·比蒂 華倫·比提|湯姆·霍伯 湯賀柏|硬盤 硬碟|科恩兄弟 高安兄弟|"
    "簡·坎皮恩 珍·甘比茵|米歇爾·阿扎納維西於斯 米高·哈薩拿維斯|約瑟夫·曼凱維奇 約瑟·曼基威士|編程語言 程式語言|羅伯特·懷斯 羅拔·淮斯|羅伯特·澤米吉斯 羅拔·湛米基斯|羅伯特·雷德福 羅拔·烈福|羅得島 羅德島|"
    "羅得島州 羅德島州|肖恩·貝克 辛·貝克|舒芙蕾 梳芙厘|艾瑪·托馬斯 愛瑪·湯馬士|西弗吉尼亞 西維珍尼亞|西弗吉尼亞州 西維珍尼亞州|詹姆斯·卡梅隆 占士·金馬倫|諾蘭 路蘭|賓夕法尼亞 賓夕凡尼亞|賓夕法尼亞州 賓夕凡尼亞州|"
    "邁克·尼科爾斯 米克·尼高斯|邁克爾·道格拉斯 米高·德格拉斯|阿黛爾·羅曼斯基 愛黛兒·羅曼斯基|隱私權 私隱權|馬丁·斯科塞斯 馬田·史高西斯|馬里蘭 馬利蘭|馬里蘭州 馬利蘭州|鼠標 滑鼠"
)
HK_PHRASES_REV = (
    "丹尼·波爾 丹尼·博伊爾|伊利諾 伊利諾伊|伊利諾州 伊利諾伊州|伊力·卡山 伊利亞·卡贊|伺服器 服務器|佐治·古尼 喬治·克魯尼|作業系統 操作系統|保羅·夏傑斯 保羅·哈吉斯|保羅·湯馬士·安德遜 保羅·托馬斯·安德森|"
    "北卡羅萊納 北卡羅來納|北卡羅萊納州 北卡羅來納州|南卡羅萊納 南卡羅來納|南卡羅萊納州 南卡羅來納州|占士·金馬倫 詹姆斯·卡梅隆|古利姆·迪托路 吉列爾莫·德爾托羅|史提夫·麥昆 史蒂夫·麥奎因|史提芬·史匹堡 斯蒂芬·斯皮爾伯格|"
    "嘉芙蓮·碧格露 凱瑟琳·畢格羅|基斯杜化·路蘭 克里斯托弗·諾蘭|大衛·連 大衛·利恩|奇連·伊士活 克林特·伊斯特伍德|奇雲·高士拿 凱文·科斯特納|奧克拉荷馬 俄克拉何馬|奧克拉荷馬州 俄克拉何馬州|奧利華·史東 奧利弗·斯通|"
    "威廉·佛烈金 威廉·弗萊德金|密芝根 密歇根|密芝根州 密歇根州|寬頻 寬帶|彼德·積遜 彼得·傑克遜|德薩斯 得克薩斯|德薩斯州 得克薩斯州|愛瑪·湯馬士 艾瑪·托馬斯|愛黛兒·羅曼斯基 阿黛爾·羅曼斯基|搜尋 搜索|"
    "朗·侯活 朗·霍華德|查理士·路雲 查爾斯·羅文|梳芙厘 舒芙蕾|森·曼特斯 山姆·曼德斯|概率 概率|機會率 概率|機率 幾率|法蘭絲·麥杜雯 弗朗西絲·麥克多曼德|活地·亞倫 伍迪·艾倫|游標 光標|湯賀柏 湯姆·霍伯|滑鼠 鼠標|"
    "珍·甘比茵 簡·坎皮恩|畢·彼特 布拉德·皮特|硬碟 硬盤|私隱權 隱私權|程式語言 編程語言|米克·尼高斯 邁克·尼科爾斯|米路·吉遜 梅爾·吉布森|米高·哈薩拿維斯 米歇爾·阿扎納維西於斯|米高·德格拉斯 邁克爾·道格拉斯|"
    "約瑟·曼基威士 約瑟夫·曼凱維奇|維珍尼亞 弗吉尼亞|維珍尼亞州 弗吉尼亞州|羅德島 羅得島|羅德島州 羅得島州|羅拔·淮斯 羅伯特·懷斯|羅拔·湛米基斯 羅伯特·澤米吉斯|羅拔·烈福 羅伯特·雷德福|"
    "艾力謝路·高沙里斯·依拿力圖 亞歷杭德羅·岡薩雷斯·伊納裏圖|華倫·比提 沃倫·比蒂|西維珍尼亞 西弗吉尼亞|西維珍尼亞州 西弗吉尼亞州|記憶體模組 內存條|資料夾 文件夾|賓·艾佛力 本·阿弗萊克|賓夕凡尼亞 賓夕法尼亞|"
    "賓夕凡尼亞州 賓夕法尼亞州|路蘭 諾蘭|辛·貝克 肖恩·貝克|馬利蘭 馬里蘭|馬利蘭州 馬里蘭州|馬田·史高西斯 馬丁·斯科塞斯|高安兄弟 科恩兄弟"
)

# ---- fixed values: paragraph reflow --------------------------------------------------------------
METADATA_KEYS = frozenset(
    "書名 书名 作者 原著 譯者 译者 校訂 校订 出版社 出版時間 出版时间 出版日期 版權 版权 版權頁 版权页 版權信息 版权信息 責任編輯 责任编辑 編輯 编辑 責編 责编 定價 定价 簡介 简介 前言 序章 終章 终章 尾聲 尾声 "
    "後記 后记 品牌方 出品方 授權方 授权方 電子版權 数字版权 掃描 扫描 發行 发行 OCR CIP 在版編目 在版编目 分類號 分类号 主題詞 主题词 類型 类型 標簽 标签 系列 發行日 发行日 初版 ISBN".split()
)
METADATA_SEPARATORS = ":：　·・"
TITLE_HEADING = (
    r"^(?!.{20,}[,，])(?=.{0,50}$)(目录|目錄|前言|序章|楔子|终章|尾声|尾聲|后记|後記|番外.{0,15}"
    r"|.{0,10}?第.{0,5}?([章节部卷節回][^分合的])|(?:卷|章)[一二三四五六七八九十](?:$|.{0,20}?))"
)
DIALOG = {"“": "”", "‘": "’", "「": "」", "『": "』", "﹁": "﹂", "﹃": "﹄"}
ALSO_CLOSE = {"〞": "“", "〟": "“"}
BRACKETS = {"（": "）", "(": ")", "[": "]", "［": "］", "{": "}", "｛": "｝", "<": ">", "＜": "＞", "〈": "〉", "【": "】", "《": "》", "〔": "〕", "〖": "〗"}
COMMAS = "，,、"
COLONS = "：:"
STRONG_ENDS = "。！？!?"
CLAUSE_ENDS = "。！？；：…—”」’』）】》〗〕］｝＞〉>.):!?"
LIST_BULLETS = "-*＊•‧▪◦○●※"
LIST_NUMBERS = "0123456789０１２３４５６７８９一二三四五六七八九十"
NEUTRAL_MARKS = " -/:.—–…·・～―‐‑、："
DIVIDER_GROUPS = ("".join(map(chr, range(0x2500, 0x2580))), "-=_~～", "*＊★☆")
#: White space as .NET defines it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# ---- fixed values: arity of ideographic description operators from U+2FF0 on ----------------------
IDS_ARITY = (2, 2, 3, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 1, 1)

# ---- fixed values: extended compatibility characters beyond the Kangxi radicals -------------------
UNICODE_EXTRA = "⻳ 龟|⺟ 母|〸 十|\u2329 \u3008|\u232a \u3009|﹑ 、|⸺ —|‧ ·|︰ ：|﹐ ，|﹔ ；|﹕ ：|﹖ ？|﹗ ！|ム 厶|㦳 㘽|䎛 㖈|呑 吞|尙 尚|岀 出|敻 夐|耈 耇|飮 飲"

# ---- a small seed of Simplified and Traditional characters; full tables come from a directory -----
#: Partial on purpose: everyday characters with one usual counterpart.
SEED_ST = (
    "汉漢 语語 国國 学學 说說 话話 书書 写寫 读讀 见見 观觀 听聽 问問 间間 门門 开開 关關 车車 马馬 鱼魚 鸟鳥 龙龍 龟龜 风風 飞飛 气氣 电電 脑腦 网網 络絡 线線 红紅 绿綠 蓝藍 黄黃 头頭 颜顏 发發 体體 "
    "长長 东東 华華 乐樂 业業 产產 亲親 爱愛 万萬 与與 专專 丽麗 义義 乌烏 习習 乡鄉 买買 卖賣 云雲 亚亞 仅僅 从從 仓倉 仪儀 们們 价價 众眾 优優 会會 伟偉 传傳 伤傷 伦倫 侦偵 侧側 债債 倾傾 偿償 儿兒 "
    "兰蘭 兴興 养養 兽獸 内內 冈岡 军軍 农農 冯馮 决決 况況 冻凍 净淨 减減 几幾 凤鳳 击擊 创創 删刪 别別 剂劑 剧劇 劝勸 办辦 务務 动動 劳勞 势勢 区區 医醫 协協 单單 卫衛 压壓 厅廳 历歷 厂廠 县縣 参參 "
    "双雙 变變 号號 叶葉 员員 启啟 团團 园園 围圍 图圖 圆圓 圣聖 场場 坏壞 块塊 坚堅 坛壇 垒壘 处處 备備 复復 够夠 夹夾 夺奪 奋奮 奖獎 妇婦 妈媽 孙孫 宁寧 宝寶 实實 审審 宫宮 宽寬 宾賓 对對 导導 "
    "数數 据據 转轉 换換 简簡 这這 态態 千千"
)


def pairs(text: str) -> dict[str, str]:
    """'key value|key value' as a dict; an entry without a value stands for itself."""
    out = {}
    for entry in text.split("|"):
        k, _, v = entry.partition(" ")
        out[k] = v or k
    return out


def seed(reverse: bool = False) -> dict[str, str]:
    found = [(x[0], x[1]) for x in SEED_ST.split()]
    return {t: s for s, t in found} if reverse else dict(found)


def compat_ideographs() -> dict[str, str]:
    """CJK compatibility ideographs by rule: their canonical decompositions."""
    return {chr(c): n for c in [*range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)] if (n := unicodedata.normalize("NFC", chr(c))) != chr(c)}


def unicode_compat() -> dict[str, str]:
    """Kangxi radicals by rule (compatibility decompositions), and some others."""
    out = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FD6)}
    extra = pairs(UNICODE_EXTRA)
    return out | {k: v for k, v in extra.items() if k != v}
