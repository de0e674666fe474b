"""Constants, word lists, selectors and text formats that results depend on.

They are data, not logic; every operator takes them as arguments with these defaults.
"""

# --- Fixed values: schedule pages of the two chains and of independent theatres.
CHAIN_A_SOURCE = "TOHO"
CHAIN_A_BASE = "https://hlo.tohotheater.jp"
CHAIN_A_PATH = "/net/movie/{theater_id}/schedule/list.do"
CHAIN_A_BLOCK = ".schedule-movie-detail, .m-schedule-movie-detail"
CHAIN_A_TITLE = ".schedule-movie-title, .m-schedule-movie-title, h3, h4"
CHAIN_A_TABLE = ".schedule-table, .m-schedule-table"
CHAIN_A_ANCHORS = ("/net/movie/",)

CHAIN_B_SOURCE = "United"
CHAIN_B_BASE = "https://www.unitedcinemas.jp"
CHAIN_B_PATH = "/{theater_id}/daily.php"
CHAIN_B_BLOCK = ".programBox, .movie-block, article.movie"
CHAIN_B_TITLE = "h2, h3, .movieTitle, .program-title"
CHAIN_B_TIME = ".showtime, .time, time, .schedule-time"
CHAIN_B_ANCHORS = ("/film/", "/movie/")

INDEPENDENT_SOURCE = "独立影院"

# --- Fixed values: text that stands for "no showing" in a time cell.
PLACEHOLDERS = ("-", "―", "×")

# --- Fixed values: selectors by keyword in the theatre's base URL; the first keyword found wins.
SELECTOR_PROFILES = {
    "uplink": {
        "block": "article.movie, .schedule-item, .event-item",
        "title": "h2, h3, .title",
        "time": ".time, .showtime",
    },
    "imageforum": {
        "block": ".movie-info, article, .nowShowing",
        "title": "h2, h3, .movie-title",
        "time": ".time, .showtime",
    },
    "cinemavera": {
        "block": ".program, .movie-item, article",
        "title": "h2, h3",
        "time": ".time",
    },
    "pole2": {
        "block": "article, .movie, .program",
        "title": "h2, h3, .title",
        "time": ".time, .showtime",
    },
    "ks-cinema": {
        "block": "article, .movie, table tr",
        "title": "h2, h3, .title, td",
        "time": ".time, td",
    },
    "wasedashochiku": {
        "block": "article, .movie, .program-item",
        "title": "h2, h3, .title",
        "time": ".showtime, .time",
    },
}
GENERIC_PROFILE = {
    "block": "article, .movie, .program, .film",
    "title": "h2, h3, .title, .movie-title",
    "time": ".time, .showtime",
}

# --- Fixed values: last-resort title selectors, in order, and the cap per page.
GENERIC_TITLE_SELECTORS = (
    "h1.movie-title", "h2.movie-title", "h3.movie-title",
    "h1.title", "h2.title", "h3.title",
    ".movie-title", ".film-title", ".program-title",
    "h2", "h3",
)
GENERIC_TITLE_CAP = 20
KANA_OR_HAN = "[぀-ヿ一-鿿]"

# --- Fixed values: ratings site.
RATING_SITE = "https://movie.douban.com"
SUBJECT_URL = RATING_SITE + "/subject/{id}/"
WANTED_TYPE = "movie"
CAST_SHOWN = 5
REVIEWS_KEPT = 5

# --- Fixed values: score weights and scales.
DEFAULT_WEIGHTS = {
    "rating_score_weight": 0.5,
    "rating_votes_weight": 0.2,
    "screening_count_weight": 0.2,
    "new_release_weight": 0.1,
}
LOG10_MAX_VOTES = 7.0
FULL_HOUSE_SCREENINGS = 20.0

# --- Fixed values: report wording and layout.
NO_RATING = "暂无评分"
MISSING = "—"
FILM_PREFIX = "◆"
MEDALS = ("🥇", "🥈", "🥉")
THEATER_SEPARATOR = "、"
REVIEW_PREFIX = "> 💬 "
FILM_BLOCK = (
    "### {prefix}. {display_title}\n"
    "\n"
    "| 项目 | 内容 |\n"
    "|------|------|\n"
    "| 🎬 原题 | {title_jp} |\n"
    "| 🌐 豆瓣 | [{stars}]({url}) |\n"
    "| 👤 导演 | {director} |\n"
    "| 🎭 主演 | {cast} |\n"
    "| 🏷️ 类型 | {genre} |\n"
    "| 📍 上映影院 | {theaters} |\n"
    "\n"
    "{reviews}"
)
RANKING_HEADER = (
    "| 排名 | 电影 | 推荐指数 | 豆瓣评分 | 上映影院 |\n"
    "|------|------|----------|----------|----------|"
)
RANKING_ROW = "| {label} | {title} | {score}/100 | {rating} | {theaters} |"
ISSUE_HEAD = "# {title}\n> {subtitle}\n\n---\n\n## 📅 本周上映（{week_start} ～ {week_end}）\n"
RANKING_HEAD = "\n---\n\n## 🏆 本周推荐榜 Top {top_n}\n"
NEXT_WEEK_HEAD = "\n---\n\n## 📌 下周预告（{next_start} ～ {next_end}）\n"
FOOTER_RULE = "\n---\n"
NEXT_WEEK_SHOWN = 5
NEXT_WEEK_REVIEWS = 1
TOP_SUMMARY = "   {rank}. {title} — {rating}，推荐指数 {score}/100"
TOP_SUMMARY_RATING = "豆瓣 {rating}"
TOP_SUMMARY_NO_RATING = "暂无豆瓣评分"
TOP_SUMMARY_COUNT = "📽️  本期共收录 {count} 部电影"

# --- Fixed values: archive names.
ARCHIVE_NAME = r"(?:briefing_[0-9]+_[0-9]{4}-[0-9]{2}-[0-9]{2}|step[0-9]+_[0-9]{4}-[0-9]{2}-[0-9]{2})\.md"
ARCHIVE_GLOB = "{briefing_*,step*_*}.md"
ISSUE_NAME = "briefing_%03d_%s.md"

# --- Fixed values: inline styles of the published article.
HEADING_STYLES = {
    "h1": "font-size:1.6em;font-weight:bold;text-align:center;",
    "h2": "font-size:1.3em;font-weight:bold;border-left:4px solid #e8ac48;padding-left:8px;margin-top:1em;",
    "h3": "font-size:1.1em;font-weight:bold;",
}
ARTICLE_STYLE = (
    "font-family:-apple-system,BlinkMacSystemFont,'PingFang SC','Hiragino Sans GB',"
    "'Microsoft YaHei',sans-serif;font-size:15px;line-height:1.8;color:#333;"
    "max-width:680px;margin:0 auto;"
)
