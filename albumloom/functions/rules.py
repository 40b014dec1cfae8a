"""Rule chains over single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upload_rejection(w: Column, h: Column, min_side: int = 400, max_aspect: float = 3.0) -> Column:
    """Reason text of the device-side check, null when the photo may be sent."""
    ratio = F.greatest(w, h) / F.least(w, h)
    return (
        F.when((w <= 0) | (h <= 0), "无法读取图片尺寸")
        .when((w < min_side) | (h < min_side), F.concat(F.lit("分辨率过小 ("), w, F.lit("x"), h, F.lit(")")))
        .when(ratio > max_aspect, F.concat(F.lit("长宽比异常 ("), F.round(ratio.cast("decimal(18,6)"), 1).cast("string"), F.lit(")")))
    )


# fixed values: one IPv4 part and the private ranges
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PRIVATE_HOST = rf"^(?:10\.{OCTET}\.{OCTET}\.{OCTET}|172\.(?:1[6-9]|2\d|3[01])\.{OCTET}\.{OCTET}|192\.168\.{OCTET}\.{OCTET})$"


def url_problem(raw: Column) -> Column:
    """Why a service address is not acceptable, null when it is (an empty address is)."""
    url = F.trim(raw)
    scheme = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1))
    authority = F.regexp_extract(url, r"(?i)^https?://([^/]*)", 1)
    bare = F.regexp_replace(authority, r":[^:]*$", "")
    host = F.when(F.startswith(bare, F.lit("[")), F.rtrim(F.ltrim(bare, F.lit("[")), F.lit("]"))).otherwise(bare)
    return (
        F.when(url == "", None)
        .when(scheme == "", "地址必须以 http:// 或 https:// 开头")
        .when(host == "", "地址缺少主机名")
        .when(scheme == "https", None)
        .when(host.rlike(PRIVATE_HOST), None)
        .otherwise("公网地址必须使用 https://；http:// 仅允许 10.x / 172.16-31.x / 192.168.x 内网 IP")
    )


# fixed values: message parts by which failed calls are told apart
FATAL_PARTS = [
    "insufficient_user_quota", "insufficient_quota", "insufficient balance", "account balance", "insufficientbalance",
    "balance not enough", "balance is insufficient", "exceeded_current_quota", "余额不足", "欠费", "arrears", "billing",
    "payment required", "invalid_api_key", "invalid api key", "incorrect api key", "unauthorized", "authentication_error",
    "model not found", "model_not_found", "is not supported by this model", " 401 ", " 402 ", " 403 ",
]
RATE_PARTS = ["429", "RequestBurstTooFast", "Too Many Requests", "TooManyRequests"]
TRANSIENT_PARTS = [
    "500", "502", "503", "504", "Internal Server Error", "Bad Gateway", "Service Unavailable", "Gateway Timeout",
    "Connection reset", "Connection aborted", "Connection refused", "Remote end closed", "RemoteProtocolError", "ConnectionError",
]


def _any_part(text: Column, parts: list[str]) -> Column:
    # one alternation; none of the parts holds a regex sign
    return text.rlike("|".join(parts))


def error_class(message: Column) -> Column:
    """fatal, rate_limit, transient or unknown; null for calls without a message."""
    low = F.lower(message)
    return F.when(
        message.isNotNull(),
        F.when(_any_part(low, FATAL_PARTS), "fatal")
        .when(_any_part(message, RATE_PARTS) | F.contains(low, F.lit("rate_limit")), "rate_limit")
        .when(_any_part(message, TRANSIENT_PARTS), "transient")
        .otherwise("unknown"),
    )
