"""Declared shapes: nested subtitle documents and the relational tables (DDL)."""

from __future__ import annotations

BOX = "struct<x:int,y:int,width:int,height:int>"
CHAR = "struct<char:string,x:int,y:int,width:int,height:int>"
DETECTION = f"struct<text:string,confidence:double,bbox:{BOX},chars:array<{CHAR}>>"
SEGMENT = (
    f"struct<start_ms:int,end_ms:int,source:string,spoken:boolean,text:string,detections:array<{DETECTION}>>"
)
#: Superset of all document variants seen; absent fields read as null.
DOCUMENT = (
    "video string, resolution struct<width:int,height:int>, duration_ms int, frame_interval_ms int, "
    f"subtitle_source string, segments array<{SEGMENT}>"
)
SPEECH = (
    "video string, words array<struct<word:string,start:double,end:double>>, "
    "segments array<struct<text:string,start:double,end:double>>, text string"
)

#: Relational tables; ids are text, times are UTC, preferences a variant.
TABLES = {
    "users": "id string, username string, display_name string, avatar_url string, native_language string, "
    "target_language string, learning_languages array<string>, daily_goal_minutes smallint, streak_days int, "
    "streak_last_date date, longest_streak int, total_words_learned int, total_videos_watched int, "
    "follower_count int, following_count int, premium boolean, max_reviews_per_day smallint, "
    "preferences variant, created_at timestamp, updated_at timestamp",
    "videos": "id string, title string, description string, language string, difficulty string, "
    "duration_sec smallint, tags array<string>, cdn_url string, thumbnail_url string, transcript_text string, "
    "subtitle_source string, status string, creator_id string, processed_at timestamp, view_count int, "
    "like_count int, comment_count int, bookmark_count int, created_at timestamp, updated_at timestamp",
    "vocab_words": "id string, word string, language string, frequency_rank int, pinyin string, simplified string, "
    "traditional string, tts_url string, created_at timestamp",
    "word_definitions": "id string, vocab_word_id string, video_id string, target_language string, "
    "translation string, contextual_definition string, part_of_speech string, source_sentence string, "
    "llm_provider string, created_at timestamp",
    "video_words": "id string, video_id string, vocab_word_id string, start_ms int, end_ms int, "
    "word_index smallint, display_text string, transcript_source string, created_at timestamp",
    "flashcards": "id string, user_id string, vocab_word_id string, definition_id string, source_video_id string, "
    "state smallint, stability double, difficulty double, elapsed_days double, scheduled_days double, reps int, "
    "lapses int, learning_steps int, due timestamp, last_review_at timestamp, starred boolean, "
    "client_updated_at timestamp, created_at timestamp, updated_at timestamp",
    "review_logs": "id string, user_id string, flashcard_id string, rating smallint, review_duration_ms int, "
    "state smallint, stability double, difficulty double, elapsed_days double, last_elapsed_days double, "
    "scheduled_days double, learning_steps int, reviewed_at timestamp",
    "user_views": "user_id string, video_id string, watch_percent smallint, view_count smallint, last_viewed_at timestamp",
    "user_likes": "user_id string, video_id string, created_at timestamp",
    "user_bookmarks": "user_id string, video_id string, created_at timestamp",
    "comments": "id string, video_id string, user_id string, body string, created_at timestamp, updated_at timestamp",
    "user_follows": "follower_id string, following_id string, created_at timestamp",
    "daily_progress": "user_id string, date date, minutes_active smallint, videos_watched smallint, "
    "words_learned smallint, cards_reviewed smallint",
    "pipeline_jobs": "id string, video_id string, status string, error_message string, retry_count smallint, "
    "started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp",
}
