"""Binary probing tasks: id, name and category of each."""

# The public manifest of the tasks with two labels, in order of their ids.
TASKS = (
    (5, "hist_fig_ismale", "knowledge"),
    (6, "hist_fig_isamerican", "knowledge"),
    (7, "hist_fig_ispolitician", "knowledge"),
    (21, "headline_istrump", "knowledge"),
    (22, "headline_isobama", "knowledge"),
    (23, "headline_ischina", "knowledge"),
    (24, "headline_isiran", "knowledge"),
    (26, "headline_isfrontpage", "knowledge"),
    (36, "sciq_tf", "reasoning"),
    (41, "truthqa_tf", "reasoning"),
    (42, "temp_sense", "reasoning"),
    (44, "phys_tf", "reasoning"),
    (47, "reasoning_tf", "reasoning"),
    (48, "cm_correct", "reasoning"),
    (49, "cm_isshort", "reasoning"),
    (50, "deon_isvalid", "reasoning"),
    (51, "just_is", "reasoning"),
    (52, "virtue_is", "reasoning"),
    (54, "cs_tf", "reasoning"),
    (56, "wikidatasex_or_gender", "knowledge"),
    (57, "wikidatais_alive", "knowledge"),
    (58, "wikidatapolitical_party", "knowledge"),
    (59, "wikidata_occupation_isjournalist", "knowledge"),
    (60, "wikidata_occupation_isathlete", "knowledge"),
    (61, "wikidata_occupation_isactor", "knowledge"),
    (62, "wikidata_occupation_ispolitician", "knowledge"),
    (63, "wikidata_occupation_issinger", "knowledge"),
    (64, "wikidata_occupation_isresearcher", "knowledge"),
    (65, "high-school", "science"),
    (66, "living-room", "science"),
    (67, "social-security", "science"),
    (68, "credit-card", "science"),
    (69, "blood-pressure", "science"),
    (70, "prime-factors", "science"),
    (71, "social-media", "science"),
    (72, "gene-expression", "science"),
    (73, "control-group", "science"),
    (74, "magnetic-field", "science"),
    (75, "cell-lines", "science"),
    (76, "trial-court", "science"),
    (77, "second-derivative", "science"),
    (78, "north-america", "science"),
    (79, "human-rights", "science"),
    (80, "side-effects", "science"),
    (81, "public-health", "science"),
    (82, "federal-government", "science"),
    (83, "third-party", "science"),
    (84, "clinical-trials", "science"),
    (85, "mental-health", "science"),
    (87, "glue_cola", "glue"),
    (89, "glue_mrpc", "glue"),
    (90, "glue_qnli", "glue"),
    (91, "glue_qqp", "glue"),
    (92, "glue_sst2", "glue"),
    (94, "ai_gen", "moderation"),
    (95, "toxic_is", "moderation"),
    (96, "spam_is", "moderation"),
    (100, "news_fake", "moderation"),
    (105, "click_bait", "moderation"),
    (106, "hate_hate", "moderation"),
    (107, "hate_offensive", "moderation"),
    (110, "aimade_humangpt3", "moderation"),
    (113, "movie_sent", "sentiment"),
    (114, "nyc_borough_Manhattan", "knowledge"),
    (115, "nyc_borough_Brooklyn", "knowledge"),
    (116, "nyc_borough_Bronx", "knowledge"),
    (117, "us_state_FL", "knowledge"),
    (118, "us_state_CA", "knowledge"),
    (119, "us_state_TX", "knowledge"),
    (120, "us_timezone_Chicago", "knowledge"),
    (121, "us_timezone_New_York", "knowledge"),
    (122, "us_timezone_Los_Angeles", "knowledge"),
    (123, "world_country_United_Kingdom", "knowledge"),
    (124, "world_country_United_States", "knowledge"),
    (125, "world_country_Italy", "knowledge"),
    (126, "art_type_book", "knowledge"),
    (127, "art_type_song", "knowledge"),
    (128, "art_type_movie", "knowledge"),
    (129, "arith_mc_A", "reasoning"),
    (130, "temp_cat_Frequency", "reasoning"),
    (131, "temp_cat_Typical Time", "reasoning"),
    (132, "temp_cat_Event Ordering", "reasoning"),
    (133, "context_type_Causality", "reasoning"),
    (134, "context_type_Belief_states", "reasoning"),
    (135, "context_type_Event_duration", "reasoning"),
    (136, "glue_mnli_entailment", "glue"),
    (137, "glue_mnli_neutral", "glue"),
    (138, "glue_mnli_contradiction", "glue"),
    (139, "news_class_Politics", "moderation"),
    (140, "news_class_Technology", "moderation"),
    (141, "news_class_Entertainment", "moderation"),
    (142, "cancer_cat_Thyroid_Cancer", "science"),
    (143, "cancer_cat_Lung_Cancer", "science"),
    (144, "cancer_cat_Colon_Cancer", "science"),
    (145, "disease_class_digestive system diseases", "science"),
    (146, "disease_class_cardiovascular diseases", "science"),
    (147, "disease_class_nervous system diseases", "science"),
    (148, "twt_emotion_worry", "sentiment"),
    (149, "twt_emotion_happiness", "sentiment"),
    (150, "twt_emotion_sadness", "sentiment"),
    (151, "it_tick_HR Support", "other"),
    (152, "it_tick_Hardware", "other"),
    (153, "it_tick_Administrative rights", "other"),
    (154, "athlete_sport_football", "other"),
    (155, "athlete_sport_basketball", "other"),
    (156, "athlete_sport_baseball", "other"),
    (157, "amazon_5star", "sentiment"),
    (158, "code_C", "code"),
    (159, "code_Python", "code"),
    (160, "code_HTML", "code"),
    (161, "agnews_0", "moderation"),
    (162, "agnews_1", "moderation"),
    (163, "agnews_2", "moderation"),
)
